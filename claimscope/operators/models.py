"""Model jobs on MLlib: scaling, linear and tree models, PCA, search, voting and stacking."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.operators.evaluate import spearman


def scale(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` standardised with the mean and population deviation of ``train`` (one broadcast row); constant columns become 0."""
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    out = rows.crossJoin(F.broadcast(stats))
    return out.select(*[c for c in rows.columns if c not in columns], *[F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0).alias(c) for c in columns])


def _assembled(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip")


def _elastic(alpha: float, mix: float, deviation: float) -> LinearRegression:
    """Loss 1/2n |y - Xw|^2 + alpha * (mix |w|_1 + (1 - mix) / 2 |w|^2). MLlib fits the label over its deviation, which divides the second penalty by it."""
    first, second = alpha * mix, alpha * (1 - mix) * deviation
    return LinearRegression(regParam=first + second, elasticNetParam=first / (first + second) if first + second else 0.0, standardization=False)


#: By name, from the number of training rows and the population deviation of their label.
REGRESSORS = {
    "ridge": lambda n, s: _elastic(1.0 / n, 0.0, s),
    "lasso": lambda n, s: _elastic(0.01, 1.0, s),
    "elastic_net": lambda n, s: _elastic(0.01, 0.5, s),
    "huber": lambda n, s: LinearRegression(loss="huber", standardization=False),
    "forest": lambda n, s: RandomForestRegressor(numTrees=20, maxDepth=5, seed=42),
    "boosted": lambda n, s: GBTRegressor(maxIter=10, maxDepth=3, seed=42),
}


def regress(train: DataFrame, test: DataFrame, columns: list[str], label: str, key: str, kind: str) -> DataFrame:
    """(key, label, prediction) on ``test`` of the regressor named ``kind``. Ridge divides its penalty by the number of rows, as MLlib's loss is a mean."""
    size = train.agg(F.count("*").alias("n"), F.coalesce(F.stddev_pop(label), F.lit(0.0)).alias("s")).first()
    model = Pipeline(stages=[_assembled(columns), REGRESSORS[kind](max(1, size.n), size.s or 1.0).setLabelCol(label)]).fit(train)
    return model.transform(test).select(key, label, "prediction")


def balanced_weights(rows: DataFrame, label: str, positive: float | None = None) -> DataFrame:
    """Adds ``weight``: n / (2 * class size), or ``positive`` for the positive class and 1 else. Counts are a row a class."""
    if positive is not None:
        return rows.withColumn("weight", F.when(F.col(label) == 1, positive).otherwise(1.0))
    n = rows.groupBy(label).agg(F.count("*").alias("_c"))
    total = n.agg(F.sum("_c").alias("_t"))
    return rows.join(F.broadcast(n.crossJoin(total).select(label, (F.col("_t") / (2 * F.col("_c"))).alias("weight"))), label)


def classify(train: DataFrame, test: DataFrame, columns: list[str], label: str, key: str, kind: str = "logistic", positive: float | None = None) -> DataFrame:
    """(key, label, prob) on ``test``; no rows if a class has fewer than five."""
    sizes = {r[0]: r[1] for r in train.groupBy(label).count().collect()}  # a row a class
    if min((sizes.get(c, 0) for c in (0, 1)), default=0) < 5:
        return test.select(key, label, F.lit(0.0).alias("prob")).limit(0)
    est = LogisticRegression(labelCol=label, weightCol="weight") if kind == "logistic" else GBTClassifier(labelCol=label, weightCol="weight", maxIter=10, maxDepth=3, seed=42)
    model = Pipeline(stages=[_assembled(columns), est]).fit(balanced_weights(train, label, positive))
    return model.transform(test).select(key, label, F.element_at(vector_to_array("probability"), 2).alias("prob"))


def principal_components(rows: DataFrame, vector: str, k: int) -> DataFrame:
    """Rows with ``pca``: the first k components of an array column."""
    from pyspark.ml.functions import array_to_vector

    held = rows.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(held).transform(held).withColumn("pca", vector_to_array("_p")).drop("_v", "_p")


class SpearmanEvaluator(Evaluator):
    """Rank correlation of prediction and label, for cross-validation."""

    def __init__(self, label: str):
        super().__init__()
        self.label = label

    def _evaluate(self, dataset: DataFrame) -> float:
        row = spearman(dataset.select(F.lit(1).alias("g"), "prediction", self.label), ["g"], "prediction", self.label).first()
        return row.rho if row else 0.0

    def isLargerBetter(self) -> bool:  # noqa: N802
        return True


def grid_search(rows: DataFrame, columns: list[str], label: str, fold: str, penalties: list[float], mixes: list[float] | None = None, folds: int = 5, parallelism: int = 2) -> DataFrame:
    """(penalty, mix, mean_rho, is_best) of elastic nets over given folds, ``mix`` from 0 (ridge) to 1 (lasso); ties to the first setting. The score is rank correlation."""
    est = LinearRegression(labelCol=label, standardization=False)
    grid = ParamGridBuilder().addGrid(est.regParam, penalties).addGrid(est.elasticNetParam, mixes or [0.5]).build()
    held = _assembled(columns).transform(rows).withColumn(fold, F.col(fold).cast("int"))
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=SpearmanEvaluator(label), numFolds=folds, foldCol=fold, parallelism=parallelism).fit(held)
    best = max(range(len(grid)), key=lambda i: (round(cv.avgMetrics[i], 12), -i))
    found = [(float(g[est.regParam]), float(g[est.elasticNetParam]), float(m), i == best) for i, (g, m) in enumerate(zip(grid, cv.avgMetrics, strict=True))]
    return rows.sparkSession.createDataFrame(found, "penalty double, mix double, mean_rho double, is_best boolean")  # a row a setting


def vote(parts: list[DataFrame], key: str, label: str) -> DataFrame:
    """Mean prediction of several models by key."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(key, label).agg(F.avg("prediction").alias("prediction"))


def stack(rows: DataFrame, test: DataFrame, columns: list[str], label: str, key: str, fold: str, kinds: list[str], folds: int = 3) -> DataFrame:
    """Out-of-fold predictions of ``kinds`` as features of a ridge model, applied to ``test``."""
    oof = None
    for f in range(folds):
        part = None
        for kind in kinds:
            p = regress(rows.filter(F.col(fold) != f), rows.filter(F.col(fold) == f), columns, label, key, kind).withColumnRenamed("prediction", kind)
            part = p if part is None else part.join(p.drop(label), key)
        oof = part if oof is None else oof.unionByName(part)
    final = None
    for kind in kinds:
        p = regress(rows, test, columns, label, key, kind).withColumnRenamed("prediction", kind)
        final = p if final is None else final.join(p.drop(label), key)
    return regress(oof, final, kinds, label, key, "ridge")
