"""Classifiers, projections and model selection on pyspark.ml."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import PowerIterationClustering
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from ..session import kept
from . import metrics, votes as V
from .labels import AT
from .sampling import by_hash, class_weights, stratified_folds


def weighted(df: DataFrame, label: str) -> DataFrame:
    """df with a ``weight`` that balances its classes."""
    return df.join(F.broadcast(class_weights(df, label).select(label, "weight")), label)  # one row per class


def _pipeline(features: list[str], label: str, stage, pca: int | None = None) -> Pipeline:
    index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip", stringOrderType="alphabetAsc")
    stages = [index, VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True)]
    if pca:
        stages.append(PCA(k=pca, inputCol="_scaled", outputCol="_features"))
    stages.append(stage.setFeaturesCol("_features" if pca else "_scaled").setLabelCol("_label").setPredictionCol("_prediction"))
    return Pipeline(stages=stages)


def logistic(features: list[str], label: str, pca: int | None = None) -> Pipeline:
    return _pipeline(features, label, LogisticRegression(maxIter=100, regParam=0.01, weightCol="weight"), pca)


def forest(features: list[str], label: str, trees: int = 300) -> Pipeline:
    return _pipeline(features, label, RandomForestClassifier(numTrees=trees, maxDepth=12, seed=42, weightCol="weight"))


def perceptron(features: list[str], label: str, classes: int, hidden: tuple[int, ...] = (128, 64)) -> Pipeline:
    return _pipeline(features, label, MultilayerPerceptronClassifier(layers=[len(features), *hidden, classes], maxIter=60, seed=42))


def predicted(model, df: DataFrame, label: str, out: str = "predicted") -> DataFrame:
    """df with the predicted label's name; rows with a gap in their features are left out."""
    names = model.stages[0].labels
    return IndexToString(inputCol="_prediction", outputCol=out, labels=names).transform(model.transform(df)).drop("_label", "_raw", "_scaled", "_features", "_prediction", "rawPrediction", "probability")


def out_of_fold(df: DataFrame, key: str, label: str, make, folds: int = 5) -> DataFrame:
    """Predictions of each row by a model that hasn't seen its fold."""
    t = kept(stratified_folds(df, key, [label], folds))
    out = None
    for k in range(folds):
        model = make().fit(weighted(t.where(F.col("fold") != k), label))
        part = predicted(model, t.where(F.col("fold") == k), label)
        out = part if out is None else out.unionByName(part)
    return out


def grid(df: DataFrame, key: str, label: str, sets: dict[str, list[str]], makes: dict, labels: tuple[str, ...], folds: int = 5) -> DataFrame:
    """feature_set, model, macro_recall: every model over every set of features, by predictions out of fold."""
    out = None
    for name, features in sets.items():
        for model, make in makes.items():
            p = out_of_fold(df, key, label, lambda f=features, m=make: m(f, label), folds)
            one = metrics.macro_recall(p.withColumns({"feature_set": F.lit(name), "model": F.lit(model)}), label, "predicted", labels, ["feature_set", "model"])
            out = one if out is None else out.unionByName(one)
    return out


def greedy_selection(df: DataFrame, models: list[str], gold: str, key: str, most: int = 4, folds: int = 5, gain: float = 1e-6) -> list[tuple[list[str], float]]:
    """Forward selection of voters for the lookup stacker by inner cross-validation: (chosen so far, mean macro recall) per step.

    Candidates times folds are scored over cell counts: (votes of the trial,
    fold, gold) has few rows, so one aggregation serves all models and folds.
    """
    t = stratified_folds(df.where(F.col(gold).isNotNull()), key, [gold], folds)
    cells = t.groupBy(*models, "fold", gold).agg(F.count("*").alias("n")).collect()  # at most 3^K * folds * 3 rows
    chosen: list[str] = []
    trace: list[tuple[list[str], float]] = []
    best = -1.0
    while len(chosen) < min(most, len(models)):
        scored = []
        for m in models:
            if m in chosen:
                continue
            trial = [*chosen, m]
            scores = []
            for k in range(folds):
                table: dict[tuple, dict[str, int]] = {}
                for r in cells:
                    if r["fold"] != k:
                        c = table.setdefault(tuple(r[x] for x in trial), {})
                        c[r[gold]] = c.get(r[gold], 0) + r["n"]
                right, support = {}, {}
                for r in cells:
                    if r["fold"] == k:
                        c = table.get(tuple(r[x] for x in trial))
                        label = max(sorted(c), key=lambda g: c[g]) if c else "FALSE"
                        support[r[gold]] = support.get(r[gold], 0) + r["n"]
                        right[r[gold]] = right.get(r[gold], 0) + (r["n"] if label == r[gold] else 0)
                scores.append(np.mean([right[g] / support[g] for g in support]) if support else 0.0)
            scored.append((float(np.mean(scores)), m))
        top, m = max(scored, key=lambda x: (x[0], -models.index(x[1])))
        if top <= best + gain:
            break
        best = top
        chosen.append(m)
        trace.append((list(chosen), top))
    return trace


def nested_cv(df: DataFrame, models: list[str], gold: str, key: str, folds: int = 5, most: int = 4) -> DataFrame:
    """fold, chosen, macro_recall: outer folds, each with its own greedy selection on the rest."""
    t = stratified_folds(df.where(F.col(gold).isNotNull()), key, [gold], folds).withColumnRenamed("fold", "outer")
    t = kept(t)
    out = None
    for k in range(folds):
        rest, held = t.where(F.col("outer") != k), t.where(F.col("outer") == k)
        trace = greedy_selection(rest, models, gold, key, most)
        chosen = trace[-1][0] if trace else models[:1]
        votes = lambda d: d.withColumn("votes", F.array(*chosen))
        p = V.apply_lookup(votes(held), V.build_lookup(votes(rest), "votes", gold), "votes")
        m = metrics.macro_recall(p.withColumn("fold", F.lit(k)).withColumn("chosen", F.lit("+".join(chosen))), gold, "stacked", AT, ["fold", "chosen"])
        out = m if out is None else out.unionByName(m)
    return out


class SpectralMap:
    """Laplacian eigenmap of a bounded sample with a Nystroem extension.

    ``fit`` takes at most ``most`` vectors (a dense eigenproblem on the
    driver); ``transform`` maps any number, as the weighted mean of the
    coordinates of their nearest sample vectors, in Arrow batches.
    """

    def __init__(self, components: int = 10, near: int = 20, most: int = 4_000):
        self.components, self.near, self.most = components, near, most

    def fit(self, df: DataFrame, vector: str, *order: str) -> SpectralMap:
        rows = by_hash(df.select(vector, *order).where(F.col(vector).isNotNull()), list(order or (vector,)), self.most).select(vector).collect()
        x = np.array([r[0] for r in rows], dtype=np.float64)
        n, k = len(x), min(self.near, len(x) - 1)
        d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0))
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1)[:, :k]
        dist = np.take_along_axis(d, near, 1)
        self.sigma = float(np.median(dist)) or 1.0
        w = np.zeros((n, n))
        w[np.arange(n)[:, None], near] = np.exp(-((dist / self.sigma) ** 2))
        w = np.maximum(w, w.T)
        deg = w.sum(1)
        s = 1 / np.sqrt(np.where(deg > 0, deg, 1))
        values, vectors = np.linalg.eigh(np.eye(n) - s[:, None] * w * s)
        self.eigenvalues = values[1 : self.components + 1]
        self.x, self.embedding = x, vectors[:, 1 : self.components + 1]
        return self

    def coordinates(self, q: np.ndarray) -> np.ndarray:
        d = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (self.x**2).sum(1) - 2 * q @ self.x.T, 0))
        k = min(self.near, len(self.x))
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        w = np.exp(-((np.take_along_axis(d, near, 1) / self.sigma) ** 2)) + 1e-12
        return np.einsum("ij,ijk->ik", w / w.sum(1, keepdims=True), self.embedding[near])

    def transform(self, df: DataFrame, key: str, vector: str) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)

        def work(batches):
            for b in batches:
                if len(b):
                    b[vector] = list(shared.value.coordinates(np.stack(b[vector]).astype(np.float64)))
                    yield b

        return df.select(key, vector).where(F.col(vector).isNotNull()).mapInPandas(work, f"{key} {dict(df.dtypes)[key]}, {vector} array<double>")


def most_likely_clusters(eigenvalues: np.ndarray, most: int = 10) -> int:
    """The number of clusters before the largest gap of the eigenvalues."""
    gaps = np.diff(eigenvalues[: most + 1])
    return int(np.argmax(gaps)) + 1 if len(gaps) else 1


def subtypes(edges: DataFrame, k: int) -> DataFrame:
    """id, cluster by power iteration over affinity edges (src, dst, weight)."""
    return PowerIterationClustering(k=k, maxIter=20, initMode="degree", srcCol="src", dstCol="dst", weightCol="weight").assignClusters(edges)


def silhouette(df: DataFrame, features: list[str], cluster: str) -> float:
    v = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip").transform(df).withColumn("_c", F.col(cluster).cast("int"))
    return ClusteringEvaluator(featuresCol="_v", predictionCol="_c").evaluate(v)
