"""Training, selection, scoring and projection with Spark ML."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Mapping, Sequence
from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator
from pyspark.ml.feature import PCA, StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisieve.functions.fingerprint import add_sparse_vector, fold
from lexisieve.operators.balancing import kfold, stratified_folds
from lexisieve.operators.index import global_rank
from lexisieve.operators.knn import knn_join
from lexisieve.session import VECTOR_BYTES, compact, concurrently, materialize

# Fingerprint sizes of the grid.
FINGERPRINT_SIZES = (64, 128, 256, 512, 1024, 2048)

#: Classifiers in the order of their start, so that no long fit is left alone at the end.
_SLOWEST_FIRST = ("SVM", "KNN", "GBT", "RF", "LR", "DT", "NB")


def classifiers(seed: int = 0) -> dict[str, tuple[object, dict[str, list]]]:
    """Estimators, with the library's own numbers of iterations, and the parameter values searched for each."""
    common = {"featuresCol": "features", "labelCol": "label"}
    return {
        "RF": (RandomForestClassifier(seed=seed, **common), {"numTrees": [20, 50], "maxDepth": [5, 10]}),
        "GBT": (GBTClassifier(seed=seed, **common), {"maxDepth": [3, 5]}),
        "SVM": (LinearSVC(tol=1e-4, **common), {"regParam": [0.01, 0.1, 1.0]}),
        "DT": (DecisionTreeClassifier(seed=seed, **common), {"maxDepth": [3, 5, 10]}),
        "NB": (NaiveBayes(modelType="gaussian", **common), {}),
        "LR": (LogisticRegression(tol=1e-4, **common), {"regParam": [0.001, 0.01, 0.1]}),
    }


def param_maps(estimator, values: Mapping[str, list], draws: int | None = None, seed: int = 0) -> list[dict]:
    """The full grid, or ``draws`` distinct random points of it."""
    if not values:
        return [{}]
    grid = [dict(zip(values, point)) for point in itertools.product(*values.values())]
    if draws is not None and draws < len(grid):
        grid = random.Random(seed).sample(grid, draws)
    return [{estimator.getParam(n): v for n, v in point.items()} for point in grid]


def _named(params: Mapping) -> str:
    return ",".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda kv: kv[0].name))


class _SharedPipeline(Pipeline):
    """A pipeline whose stages before the last are fitted once for all points of a grid, which differ in the last."""

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[Mapping]):  # noqa: N802, N803
        *first, last = self.getStages()
        shared = Pipeline(stages=first).fit(dataset)
        fitted = last.fitMultiple(shared.transform(dataset), paramMaps)
        return map(lambda pair: (pair[0], PipelineModel([*shared.stages, pair[1]])), fitted)


def _pipeline(estimator, variance: float | None) -> Pipeline:
    if variance is None:
        return _SharedPipeline(stages=[estimator.copy({estimator.featuresCol: "features"})])
    selector = VarianceThresholdSelector(
        featuresCol="features", outputCol="selected", varianceThreshold=variance)
    return _SharedPipeline(stages=[selector, estimator.copy({estimator.featuresCol: "selected"})])


def _training_table(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in one partition per stored MB of vectors. Every iteration of a fit sends its table's plan
    to the executors: that of a checkpoint is short, and its partitions are read from anywhere."""
    return compact(materialize(df), VECTOR_BYTES).checkpoint()


def _at_once(data: DataFrame, most: int) -> int:
    """Fits to run side by side, ``most`` of them: two tasks a core, and two fits at least."""
    cores = data.sparkSession.sparkContext.defaultParallelism
    return max(2, min(most, 2 * cores // data.rdd.getNumPartitions()))


def train_select(df: DataFrame, folds: int = 3, seed: int = 123, names: Sequence[str] | None = None,
                 variance: float | None = 0.0, draws: int | None = 2, parallelism: int = 4,
                 id_col: str = "id", path: str | None = None) -> tuple[DataFrame, PipelineModel]:
    """Compare classifiers by cross-validated ROC AUC, tune the best, refit it
    on all rows and save it. ``df`` has ``id_col``, ``features``, ``label``.

    Returns the table ``model, params, auc`` and the fitted pipeline. Folds are
    stratified and repeatable. Features with no variance are left out. Classifiers
    are searched side by side, each ``parallelism`` points at a time.
    """
    data = _training_table(stratified_folds(df, "label", id_col, folds, seed).select(
        F.col("label").cast("double").alias("label"), "features", "fold"))
    evaluator = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction")

    def search(name: str) -> tuple[str, list[dict], object]:
        estimator, values = classifiers(seed)[name]
        grid = param_maps(estimator, values, draws, seed)
        cv = CrossValidator(estimator=_pipeline(estimator, variance), estimatorParamMaps=grid,
                            evaluator=evaluator, numFolds=folds, foldCol="fold", parallelism=parallelism)
        return name, grid, cv.fit(data)

    results, fitted = [], {}
    searched = [name for name in _SLOWEST_FIRST if name in classifiers(seed) and (names is None or name in names)]
    at_once = max(2, _at_once(data, len(searched) * parallelism) // parallelism)
    for name, grid, model in concurrently([partial(search, name) for name in searched], at_once):
        results += [(name, _named(p), float(a)) for p, a in zip(grid, model.avgMetrics)]
        fitted[name] = (max(model.avgMetrics), model.bestModel)
    best = max(fitted, key=lambda n: (fitted[n][0], n))
    if path is not None:
        fitted[best][1].write().save(path)
    table = df.sparkSession.createDataFrame(results, "model string, params string, auc double")
    return table, fitted[best][1]


def probability_of_one(predicted: DataFrame, out: str = "score") -> DataFrame:
    """P(label = 1); for a classifier without probabilities, its margin through
    the logistic function."""
    if "probability" in predicted.columns:
        return predicted.withColumn(out, vector_to_array("probability")[1])
    margin = vector_to_array("rawPrediction")[1]
    return predicted.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)))


def out_of_fold(df: DataFrame, estimator, fold: str = "fold", keep: Sequence[str] = ("id", "label"),
                folds: Sequence[int] | None = None) -> DataFrame:
    """A prediction for every row by a model that has not seen its fold. The folds' models are fitted side by side."""
    def predicted(f: int) -> DataFrame:
        model = estimator.fit(df.where(F.col(fold) != f))
        return probability_of_one(model.transform(df.where(F.col(fold) == f))).select(*keep, fold, "score")

    numbers = sorted(r[0] for r in df.select(fold).distinct().collect()) if folds is None else folds
    return reduce(DataFrame.unionByName, concurrently([partial(predicted, f) for f in numbers], len(numbers)))


#: Numbers of neighbours tried by the neighbour classifier.
NEIGHBORS = tuple(range(1, 10))


def _knn_out_of_fold(df: DataFrame, neighbors: Sequence[int] = NEIGHBORS) -> DataFrame:
    """``id, label, k, score``: votes of the ``k`` nearest rows of other folds, for every ``k``, from one join."""
    dense = df.select("id", "label", "fold", vector_to_array("features").alias("vec"))
    found = knn_join(dense, dense, "id", "vec", max(neighbors), apart="fold")
    votes = found.join(df.select(F.col("id").alias("neighbor"), F.col("label").alias("vote")), "neighbor")
    asked = votes.withColumn("k", F.explode(F.array(*map(F.lit, neighbors)))).where("rank <= k")
    scores = asked.groupBy("id", "k").agg(F.avg("vote").alias("score"))
    return df.select("id", "label").join(scores, "id").select("id", "label", "k", "score")


def model_grid(df: DataFrame, bits_col: str, id_col: str, label: str, sizes: Sequence[int] = FINGERPRINT_SIZES,
               names: Sequence[str] = ("RF", "SVM", "KNN", "NB", "DT", "LR"), folds: int = 5, draws: int = 1,
               seed: int = 0, parallelism: int = 8) -> DataFrame:
    """``bits, model, params, auc`` for every fingerprint size and classifier,
    from out-of-fold predictions. Sizes fold one wide fingerprint. Points of the grid, the slowest first, are fitted
    ``parallelism`` at a time, or as many as keep the cores busy; the neighbour classifier takes one join per size for
    all folds and numbers of neighbours."""
    base = materialize(stratified_folds(
        df.select(F.col(id_col).alias("id"), F.col(bits_col).alias("wide"), F.col(label).cast("double").alias("label")),
        "label", "id", folds, seed))
    evaluator = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="score")

    def table(bits: int) -> DataFrame:
        folded = add_sparse_vector(base.withColumn("folded", fold(F.col("wide"), bits)), "folded", bits)
        return _training_table(folded.select("id", "label", "fold", "features"))

    def neighbors(data: DataFrame, bits: int) -> list[tuple]:
        scored = materialize(_knn_out_of_fold(data))
        return [(bits, "KNN", f"k={k}", float(evaluator.evaluate(scored.where(F.col("k") == k)))) for k in NEIGHBORS]

    def point(data: DataFrame, bits: int, name: str, params: Mapping) -> list[tuple]:
        estimator = classifiers(seed)[name][0]
        scored = out_of_fold(data, _pipeline(estimator.copy(params), None), folds=numbers)
        return [(bits, name, _named(params), float(evaluator.evaluate(scored)))]

    tables = dict(zip(sizes, concurrently([partial(table, bits) for bits in sizes], parallelism)))
    numbers = sorted(r[0] for r in base.select("fold").distinct().collect())
    tasks = []
    for name in sorted(names, key=_SLOWEST_FIRST.index):
        for bits in sorted(sizes, reverse=True):
            if name == "KNN":
                tasks.append(partial(neighbors, tables[bits], bits))
                continue
            estimator, values = classifiers(seed)[name]
            tasks += [partial(point, tables[bits], bits, name, params) for params in param_maps(estimator, values, draws, seed)]
    at_once = min((_at_once(data, parallelism) for data in tables.values()), default=1)
    results = [row for rows in concurrently(tasks, at_once) for row in rows]
    return df.sparkSession.createDataFrame(results, "bits int, model string, params string, auc double")


def best_of_grid(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("auc"), "bits", "model").limit(1)


def score_rank(df: DataFrame, model: PipelineModel | str, id_col: str, keep: Sequence[str] = (),
               out: str = "score") -> DataFrame:
    """Score with a fitted or saved pipeline and rank by P(label = 1)."""
    if isinstance(model, str):
        model = PipelineModel.load(model)
    scored = probability_of_one(model.transform(df), out).select(id_col, *keep, out)
    return global_rank(scored, [F.col(out).desc(), F.col(id_col)], "rank", start=1, unique=True)


class _GroupedRMSE(Evaluator):
    """Root mean squared error of all rows, from groups of them: ``weight`` rows with mean ``label`` and the sum
    ``within`` of their squared deviations from it."""

    def _evaluate(self, dataset: DataFrame) -> float:
        error = F.col("label") - F.col("prediction")
        return math.sqrt(dataset.agg(
            F.sum(F.col("weight") * error * error + F.col("within")) / F.sum("weight")).first()[0])

    def isLargerBetter(self) -> bool:  # noqa: N802
        return False


def boosted_regression(df: DataFrame, features: Sequence[str], label: str, id_cols: Sequence[str],
                       folds: int = 3, seed: int = 0, depths: Sequence[int] = (3, 5), max_iter: int = 50) -> DataFrame:
    """Cross-validated RMSE of boosted trees per depth: ``max_depth, rmse``.

    Trees of squared errors see only the number and the mean label of rows that agree in all features, so the rows of
    a fold that do are one row with a weight; the spread inside such a group is added to the error again.
    """
    rows = df.select(F.xxhash64(*id_cols).alias("__id"), *features, F.col(label).cast("double").alias("label"))
    grouped = kfold(rows, "__id", folds, seed).groupBy("fold", *features).agg(
        F.count("label").cast("double").alias("weight"), F.avg("label").alias("__mean"),
        F.coalesce(F.var_pop("label") * F.count("label"), F.lit(0.0)).alias("within")).withColumnRenamed("__mean", "label")
    data = compact(materialize(VectorAssembler(inputCols=list(features), outputCol="features").transform(grouped).select(
        "fold", "features", "label", "weight", "within")))
    estimator = GBTRegressor(featuresCol="features", labelCol="label", weightCol="weight", maxIter=max_iter, seed=seed)
    grid = ParamGridBuilder().addGrid(estimator.maxDepth, list(depths)).build()
    model = CrossValidator(estimator=estimator, estimatorParamMaps=grid, numFolds=folds, foldCol="fold",
                           evaluator=_GroupedRMSE(), parallelism=2).fit(data)
    return df.sparkSession.createDataFrame(
        [(int(d), float(m)) for d, m in zip(depths, model.avgMetrics)], "max_depth int, rmse double")


def standardize(df: DataFrame, columns: Sequence[str], suffix: str = "_std") -> DataFrame:
    """(x - mean) / population deviation; a constant column gives 0. One
    aggregation whose single row is joined back as literals."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                   *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return df.withColumns({
        f"{c}{suffix}": (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns})


def embed_2d(df: DataFrame, vec_col: str, id_col: str, source_col: str, per_source: bool = False) -> DataFrame:
    """``source, id, x, y``: standardised and projected on two principal
    components, fitted on all sources together, or on each alone."""
    if per_source:
        names = sorted(r[0] for r in df.select(source_col).distinct().collect())
        return reduce(DataFrame.unionByName, [
            embed_2d(df.where(F.col(source_col) == n), vec_col, id_col, source_col) for n in names])
    data = df.select(source_col, id_col, array_to_vector(F.col(vec_col)).alias("raw"))
    n = data.count()
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(data).transform(data)
    reduced = PCA(k=2, inputCol="scaled", outputCol="xy").fit(scaled).transform(scaled)
    # Spark divides by the sample deviation; the convention here is the population's
    correct = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    xy = vector_to_array("xy")
    return reduced.select(source_col, id_col, (xy[0] * correct).alias("x"), (xy[1] * correct).alias("y"))


def axis_ranges(df: DataFrame) -> DataFrame:
    return df.agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"),
                  F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def grid_side(n: int) -> int:
    """Side of the square map for ``n`` rows."""
    return math.ceil(math.sqrt(5 * math.sqrt(n)))


def assign_cells(train: DataFrame, rows: DataFrame, vec_col: str, seed: int = 0, cells: int | None = None,
                 out: str = "cell") -> tuple[DataFrame, DataFrame]:
    """``train`` and ``rows`` with a k-means cell in place of a map node. The
    number of cells follows the map's rule unless ``cells`` is given."""
    k = cells or grid_side(train.count()) ** 2

    def vectors(df: DataFrame) -> DataFrame:
        return df.withColumn("__v", array_to_vector(F.col(vec_col)))

    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol=out, maxIter=10).fit(vectors(train))
    return model.transform(vectors(train)).drop("__v"), model.transform(vectors(rows)).drop("__v")


def gmm_columns(df: DataFrame, columns: Sequence[str], id_cols: Sequence[str], components: int = 10,
                seed: int = 0, max_iter: int = 100) -> tuple[DataFrame, DataFrame]:
    """Gaussian mixture per column over its non-missing rows. EM sees equal values as one row with a weight.

    Returns rows with ``<column>_component`` (-1 for missing) and a table of
    ``column, component, weight, mean, log_std``.
    """
    out, params = df, []
    for c in columns:
        present = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        vector = array_to_vector(F.array(F.coalesce(F.when(present, F.col(c).cast("double")), F.lit(0.0))))
        counted = compact(materialize(df.where(present).groupBy(F.col(c).cast("double").alias(c)).agg(
            F.count(F.lit(1)).cast("double").alias("__n"))))
        fitted = GaussianMixture(k=components, seed=seed, maxIter=max_iter, tol=1e-3, featuresCol="__v", weightCol="__n",
                                 predictionCol="__c", probabilityCol="__p").fit(
            counted.select(vector.alias("__v"), "__n"))
        for i, (weight, g) in enumerate(zip(fitted.weights, fitted.gaussians)):
            variance = float(g.cov.toArray()[0, 0])
            params.append((c, i, float(weight), float(g.mean[0]), 0.5 * math.log(variance + 1e-15)))
        out = fitted.transform(out.withColumn("__v", vector)).withColumn(
            f"{c}_component", F.when(present, F.col("__c")).otherwise(-1)).drop("__v", "__c", "__p")
    table = df.sparkSession.createDataFrame(
        params, "column string, component int, weight double, mean double, log_std double")
    return out.select(*id_cols, *[f"{c}_component" for c in columns]), table
