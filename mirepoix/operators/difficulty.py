"""Recipe difficulty: training set, classifiers, component analysis (Spark MLlib)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, IndexToString, StringIndexer, VectorAssembler, VectorIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The common schema of the difficulty sources and the settings of the tree.
FEATURES = ("COOK_TIME", "N_INGREDIENTS", "N_STEPS")
LABEL = "DIFFICULTY"
MAX_DEPTH = 10
MIN_ROWS_PER_NODE = 20


def difficulty_dataset(
    sources: Mapping[str, DataFrame],
    keys: Sequence[str] = (),
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
) -> DataFrame:
    """Stack the sources on their common, typed columns; rows without a positive cook time go."""

    def common(df: DataFrame) -> DataFrame:
        typed = [F.col(f).try_cast("int").alias(f) for f in features]
        return df.select(*keys, *typed, F.col(label).cast("string").alias(label)).filter(
            F.col(features[0]) > 0
        )

    return reduce(DataFrame.unionByName, (common(df) for df in sources.values()))


def fit_label_index(df: DataFrame, label: str = LABEL, output: str = "indexedLabel"):
    """Labels by falling frequency, ties by name. Fit on all data, so that no split misses a label."""
    return StringIndexer(inputCol=label, outputCol=output, stringOrderType="frequencyDesc").fit(df)


def label_index(df: DataFrame, label: str = LABEL) -> DataFrame:
    """(label, index, rows) as the classifiers will see them."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return fit_label_index(df, label).transform(counts).select(label, "indexedLabel", "n")


def fit_classifier(
    training: DataFrame,
    label_model,
    kind: str = "tree",
    features: Sequence[str] = FEATURES,
    max_categories: int | None = None,
    max_depth: int = MAX_DEPTH,
    min_rows: int = MIN_ROWS_PER_NODE,
    max_bins: int = 32,
) -> PipelineModel:
    """Fit a decision ``tree`` or naive ``bayes`` on the assembled features.

    ``max_categories`` lets features with at most that many values be treated as categories, which a tree parts by
    sets of values. Other features are cut between ``max_bins`` of their values: with as many bins as values, at
    every midpoint between two of them. A feature's categories must not outnumber the bins.
    """
    vector, stages = "features", [VectorAssembler(inputCols=list(features), outputCol="features")]
    if max_categories is not None:
        vector = "indexedFeatures"
        stages.append(
            VectorIndexer(
                inputCol="features", outputCol=vector, maxCategories=max_categories, handleInvalid="keep"
            )
        )
    common = {"labelCol": label_model.getOutputCol(), "featuresCol": vector}
    if kind == "tree":
        classifier = DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=min_rows, maxBins=max_bins, **common)
    elif kind == "bayes":
        classifier = NaiveBayes(**common)
    else:
        raise ValueError(f"unknown classifier {kind!r}")
    back = IndexToString(inputCol="prediction", outputCol="predictedLabel", labels=label_model.labels)
    return Pipeline(stages=[label_model, *stages, classifier, back]).fit(training)


def tree_description(model: PipelineModel) -> str:
    """The rules of the fitted tree as text."""
    return next(s for s in model.stages if hasattr(s, "toDebugString")).toDebugString


def accuracy(predictions: DataFrame, label: str = "indexedLabel") -> float:
    """Share of right predictions; 1 minus it is the test error."""
    return MulticlassClassificationEvaluator(
        labelCol=label, predictionCol="prediction", metricName="accuracy"
    ).evaluate(predictions)


def accuracy_table(predictions: Mapping[str, DataFrame], label: str = LABEL) -> DataFrame:
    """(model, accuracy, n) of several models' predictions."""
    hit = (F.col("predictedLabel") == F.col(label)).cast("double")
    rows = [
        df.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("model"), "accuracy", "n"
        )
        for name, df in predictions.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def correlation_matrix(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Pearson matrix of the features in long form: (a, b, corr)."""
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    # features x features numbers, whatever the number of rows
    matrix = Correlation.corr(vectors.select("features"), "features").head()[0].toArray()
    cells = [(a, b, float(matrix[i][j])) for i, a in enumerate(features) for j, b in enumerate(features)]
    return df.sparkSession.createDataFrame(cells, "a string, b string, corr double")


def pca_invariants(df: DataFrame, vector: str, k: int, key: str, checked: int = 5) -> DataFrame:
    """What all components have in common whatever their signs, as rows (what, key, value).

    ``norm``: the sum of squares of a row's ``k`` components; with as many components as dimensions that is the
    row's own sum of squares, as the components are an orthonormal basis. ``covariance i,j`` of two of the first
    ``checked`` components: 0. ``falling i``: 1 if component i varies no less than the next.
    """
    parts = [f"pc{i + 1}" for i in range(k)]
    rows = pca(df, vector, k, [key])
    norms = rows.select(
        F.lit("norm").alias("what"), F.col(key), reduce(lambda a, b: a + b, (F.col(c) * F.col(c) for c in parts)).alias("value")
    )
    first = parts[:checked]
    pairs = [(a, b) for i, a in enumerate(first) for b in first[i + 1 :]]
    values = {f"covariance {a[2:]},{b[2:]}": F.covar_pop(a, b) for a, b in pairs}
    # variances that are equal may come in either order
    values |= {
        f"falling {a[2:]}": (F.var_pop(a) >= F.var_pop(b) * (1 - 1e-9)).cast("double") for a, b in zip(first, first[1:])
    }
    cells = F.array(*[F.struct(F.lit(n).alias("what"), v.alias("value")) for n, v in values.items()])
    checks = rows.agg(cells.alias("cells")).select(F.explode("cells").alias("c"))
    kind = df.schema[key].dataType
    return norms.unionByName(checks.select("c.what", F.lit(None).cast(kind).alias(key), "c.value"))


def pca(df: DataFrame, vector: str, k: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Keys plus the first ``k`` principal components as columns pc1..pck of an array column."""
    vectors = df.select(*keys, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    projected = PCA(k=k, inputCol="features", outputCol="pcaFeatures").fit(vectors).transform(vectors)
    parts = vector_to_array("pcaFeatures")
    return projected.select(*keys, *[parts[i].alias(f"pc{i + 1}") for i in range(k)])
