"""Tree classifiers for a rating class: depth sweeps, grid search, final fit."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.scalars import column
from staylens.operators.checks import require_columns
from staylens.operators.evaluate import accuracy
from staylens.operators.features import (
    OneHot,
    hash_split,
    one_hot_codes,
    stratified_folds,
)
from staylens.runtime import join_sized, materialize, measure, use_checkpoint_dir

MAX_DEPTH = 30  # the deepest tree Spark grows
MAX_BINS = 256  # split candidates of a numeric feature; more distinct values are binned
MAX_CLASSES = 1000  # class names are held by the driver
MAX_COMPARED = 1_000_000  # nodes of a model that is compared with that of another depth
LABEL, FEATURES, WEIGHT, FOLD, PREDICTION = "label_index", "features", "weight", "fold", "prediction"
COPIES = "_copies"
DRAWN_ROWS, DRAWN_SHARE = 200_000, 50  # forests draw from groups: of so many rows, so many a group

# The depths that are swept and searched per family by default.
FOREST_SWEEP = range(20, 41)
FOREST_GRID = range(27, 38)
TREE_SWEEP = range(15, 41)
TREE_GRID = (2, 5, 10, 20, 25, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40)
BOOSTED_SWEEP = range(1, 16)
BOOSTED_FINAL = 10


@dataclass(frozen=True)
class ModelData:
    """Encoded rows (key, label_index, features; weight in train).

    They are not cached: what is fitted again and again is the stored table of their groups,
    or, for forests that save nothing by groups, the rows, which the sweeps cache. ``rows`` are those
    before encoding, with their ``_split``; ``cells`` counts the equal ones and is stored, so that
    what follows reads no rows; ``encode`` encodes both. ``weights`` has a weight per class.
    """

    train: DataFrame
    test: DataFrame
    key: str
    classes: list[str]
    encoder: OneHot
    rows: DataFrame
    cells: DataFrame
    encode: Callable[[DataFrame], DataFrame]
    weights: DataFrame

    def unpersist(self) -> None:
        self.train.unpersist()
        self.test.unpersist()


def prepare(
    df: DataFrame,
    key: str,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    test: float = 0.2,
    seed: int = 42,
    fit_scope: str = "train",
) -> ModelData:
    """Split, scale, encode and assemble.

    Scaling and encoding are fitted on the training rows (``fit_scope="train"``) or
    on all of them (``"all"``). Rows with a missing number or label are left out.
    Class names come from all labelled rows: a class that occurs among the test rows
    only stays there, and no model can get it right.
    Encoded slots are not scaled: trees split a 0/1 slot the same either way, and a
    scaled slot would make the sparse vectors dense.
    """
    require_columns(df, [key, label, *numeric, *categorical])
    if fit_scope not in ("train", "all"):
        raise ValueError("fit_scope is 'train' or 'all'")
    rows = df.select(
        column(key),
        column(label).cast("string").alias("_label"),
        *[column(c).cast("double").alias(c) for c in numeric],
        *[column(c).cast("string").alias(c) for c in categorical],
    ).na.drop("any", subset=["_label", *numeric])
    rows = hash_split(rows, key, test, seed, "_split")
    cells = materialize(rows.groupBy("_split", "_label", *[column(c) for c in (*numeric, *categorical)]).agg(F.count(F.lit(1)).alias(COPIES)))
    fit_cells = cells if fit_scope == "all" else cells.where(F.col("_split") == "train")
    names = cells.select("_label").distinct()
    if names.limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    labels = StringIndexer(inputCol="_label", outputCol=LABEL, stringOrderType="alphabetAsc").fit(names)
    codes = one_hot_codes(fit_cells, categorical)
    scaled = _scaled(fit_cells, numeric)
    inputs = [*numeric, *[f"{c}_vec" for c in categorical]]

    def encode(df: DataFrame) -> DataFrame:
        df = labels.transform(df.withColumns(scaled) if scaled else df)
        if categorical:
            df = codes.transform(df, [key] if key in df.columns else [*numeric, *categorical])
        return VectorAssembler(inputCols=inputs, outputCol=FEATURES).transform(df)

    encoded = encode(rows).select(column(key), LABEL, FEATURES, "_split")
    train, held_out = (encoded.where(F.col("_split") == part).drop("_split") for part in ("train", "test"))
    counts = labels.transform(cells.where(F.col("_split") == "train")).groupBy(LABEL).agg(F.sum(COPIES).alias("n")).collect()
    total = sum(r["n"] for r in counts)
    weights = df.sparkSession.createDataFrame(
        [(r[LABEL], total / (len(counts) * r["n"])) for r in counts], f"{LABEL} double, {WEIGHT} double"
    )
    train = join_sized(train, measure(weights), [LABEL], "left", [key])
    return ModelData(train, held_out, key, list(labels.labels), codes, rows, cells, encode, weights)


def _scaled(cells: DataFrame, numeric: Sequence[str]) -> dict[str, Column]:
    """Each column as ``standardize`` scales it, with the figures of the rows that ``cells`` count."""
    if not numeric:
        return {}
    n = F.sum(COPIES)
    found = cells.agg(
        *[F.try_divide(F.sum(column(c) * column(COPIES)), n).alias(f"mean_{i}") for i, c in enumerate(numeric)],
        *[(F.min(column(c)) == F.max(column(c))).alias(f"same_{i}") for i, c in enumerate(numeric)],
    ).first()
    means = [found[f"mean_{i}"] for i in range(len(numeric))]
    squares = [F.sum(F.pow(column(c) - F.lit(means[i]).cast("double"), F.lit(2)) * column(COPIES)) for i, c in enumerate(numeric)]
    deviations = cells.agg(*[F.sqrt(F.try_divide(x, n)) for x in squares]).first()
    return {
        c: F.lit(0.0) if found[f"same_{i}"] else F.try_divide(column(c) - F.lit(means[i]).cast("double"), F.lit(deviations[i]).cast("double"))
        for i, c in enumerate(numeric)
    }


def grouped(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., label_index, features, _copies): rows that are equal to a model as one, stored.

    A tree that is not fitted on drawn rows is the same on these with their numbers as weights, but for
    the split candidates of long tables, which Spark takes from a sample: of the groups, then.
    Where hardly any rows are equal the table is as long as ``rows`` are, and stands for a cache.
    """
    keys = [*by, LABEL, FEATURES]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(COPIES))
    # sums of weights do not depend on the order in which a shuffle delivers rows
    return materialize(counts.sortWithinPartitions(F.xxhash64(*keys)))


def _groups(data: ModelData, cells: DataFrame, *by: str) -> DataFrame:
    """As :func:`grouped` finds them in the encoded rows, from the counts of rows in ``cells``."""
    keys = [*by, LABEL, FEATURES]
    encoded = data.encode(cells)
    if WEIGHT in by:
        encoded = encoded.join(F.broadcast(data.weights), LABEL, "left")  # a row per class
    return materialize(encoded.groupBy(*keys).agg(F.sum(COPIES).alias(COPIES)).sortWithinPartitions(F.xxhash64(*keys)))


def _cells(data: ModelData, split: str) -> DataFrame:
    return data.cells.where(F.col("_split") == split)


def _each(spark, work: Callable, items: Sequence, parallelism: int) -> list:
    """Run ``work`` per item; up to ``parallelism`` fits share the cluster."""
    if parallelism <= 1:
        return [work(item) for item in items]
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items)


@dataclass(frozen=True)
class OneVsRestTrees:
    """One binary boosted model per class; the class with the largest margin wins."""

    models: list[GBTClassificationModel]

    def transform(self, df: DataFrame) -> DataFrame:
        kept = df.columns
        margins = []
        for i, model in enumerate(self.models):
            margin = model.copy({model.rawPredictionCol: "_raw", model.probabilityCol: "", model.predictionCol: ""})
            df = margin.transform(df)
            df = df.withColumn(f"_margin_{i}", vector_to_array("_raw")[1]).drop("_raw")
            margins.append(F.col(f"_margin_{i}"))
        best = F.array_position(F.array(*margins), F.greatest(*margins)) - 1
        return df.select(*[column(c) for c in kept], best.cast("double").alias(PREDICTION))


@dataclass(frozen=True)
class DrawnForest:
    """Trees that were fitted one by one on drawn groups; the class with the largest sum of shares wins."""

    models: list[RandomForestClassificationModel]

    def transform(self, df: DataFrame) -> DataFrame:
        kept, shares = df.columns, []
        for i, model in enumerate(self.models):
            df = model.copy({model.rawPredictionCol: "", model.probabilityCol: f"_share_{i}", model.predictionCol: ""}).transform(df)
            shares.append(vector_to_array(f"_share_{i}"))
        none = F.array().cast("array<double>")  # a tree without rows of the last classes has no slots for them
        add = lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))
        df = df.withColumn("_sums", F.aggregate(F.array(*shares), none, lambda sums, one: F.zip_with(sums, one, add)))
        best = F.array_position("_sums", F.array_max("_sums")) - 1
        return df.select(*[column(c) for c in kept], best.cast("double").alias(PREDICTION))


def _drawn(groups: DataFrame, trees: int, seed: int) -> DataFrame:
    """Add ``_drawn``: how many of a group's rows each tree draws.

    Each row is drawn a Poisson number of times with mean 1, as Spark's forests do, so the
    rows of a group together with a mean of their number. It depends on seed and group only.
    """

    @F.pandas_udf("array<long>")
    def draw(key: pd.Series, copies: pd.Series) -> pd.Series:
        rng = lambda k: np.random.Generator(np.random.PCG64([seed, k & 0xFFFFFFFFFFFFFFFF]))
        return pd.Series([rng(int(k)).poisson(n, trees) for k, n in zip(key, copies)], dtype=object)

    keys = [c for c in groups.columns if c not in (COPIES, WEIGHT)]
    return groups.withColumn("_drawn", draw(F.xxhash64(*keys), COPIES))


@dataclass(frozen=True)
class TreeFamily:
    """How one family of trees is fitted at a given depth."""

    name: str
    fit: Callable[[DataFrame, int, int], object]  # rows, depth, number of classes
    balanced: bool = True
    # whether equal rows may be fitted as one with their number in ``_copies``: not where rows are
    # drawn, nor where the rows of a node are counted
    groups: bool = False
    # whether it can draw from groups with ``_copies``, which pays where rows repeat often
    drawn: bool = False


def forest(
    num_trees: int = 100, seed: int = 42, balanced: bool = True, max_bins: int = MAX_BINS, min_instances: int = 1, parallelism: int = 8
) -> TreeFamily:
    """Spark's forests; on groups (see :func:`_repeat`) each tree is a fit of its own on the rows it draws."""

    def fit_drawn(groups: DataFrame, depth: int) -> DrawnForest:
        drawn = _drawn(groups, num_trees, seed).persist(StorageLevel.MEMORY_AND_DISK)
        drawn.count()

        def one_tree(i: int) -> RandomForestClassificationModel:
            estimator = RandomForestClassifier(
                featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION, impurity="entropy",
                maxDepth=depth, numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", seed=seed + i,
                maxMemoryInMB=1024, maxBins=max_bins, weightCol=WEIGHT,
            )
            times = F.col("_drawn")[i].cast("double")
            weight = times * F.col(WEIGHT) if balanced else times
            return estimator.fit(drawn.where(times > 0).select(LABEL, FEATURES, weight.alias(WEIGHT)))

        try:
            return DrawnForest(_each(groups.sparkSession, one_tree, range(num_trees), parallelism))
        finally:
            drawn.unpersist()

    def fit(rows: DataFrame, depth: int, classes: int):
        use_checkpoint_dir(rows.sparkSession)
        if COPIES in rows.columns:
            return fit_drawn(rows, depth)
        estimator = RandomForestClassifier(
            featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION, impurity="entropy",
            maxDepth=depth, numTrees=num_trees, seed=seed, cacheNodeIds=True, maxMemoryInMB=1024,
            maxBins=max_bins, minInstancesPerNode=min_instances,
        )
        return _weighted(estimator, balanced, rows).fit(rows)

    return TreeFamily("random_forest", fit, balanced, drawn=num_trees > 1 and min_instances == 1)


def tree(seed: int = 42, balanced: bool = True, max_bins: int = MAX_BINS, min_instances: int = 1) -> TreeFamily:
    def fit(rows: DataFrame, depth: int, classes: int):
        use_checkpoint_dir(rows.sparkSession)
        estimator = DecisionTreeClassifier(
            featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION, impurity="entropy",
            maxDepth=depth, seed=seed, cacheNodeIds=True, maxMemoryInMB=1024,
            maxBins=max_bins, minInstancesPerNode=min_instances,
        )
        return _weighted(estimator, balanced, rows).fit(rows)

    return TreeFamily("decision_tree", fit, balanced, groups=min_instances == 1)


def boosted(
    rounds: int = 100, step: float = 0.3, seed: int = 42, parallelism: int = 1, max_bins: int = MAX_BINS, min_instances: int = 1
) -> TreeFamily:
    """Spark's boosted trees are binary, so each class gets a model of its own."""

    def fit(rows: DataFrame, depth: int, classes: int):
        use_checkpoint_dir(rows.sparkSession)

        def one_class(c: int) -> GBTClassificationModel:
            estimator = GBTClassifier(
                featuresCol=FEATURES, labelCol="_is_class", maxDepth=depth, maxIter=rounds,
                stepSize=step, seed=seed, maxMemoryInMB=1024,
                maxBins=max_bins, minInstancesPerNode=min_instances,
            )
            return _weighted(estimator, False, rows).fit(rows.withColumn("_is_class", (F.col(LABEL) == c).cast("double")))

        return OneVsRestTrees(_each(rows.sparkSession, one_class, range(classes), parallelism))

    return TreeFamily("boosted_trees", fit, balanced=False, groups=min_instances == 1)


def _weighted(estimator, balanced: bool, rows: DataFrame):
    if balanced:
        return estimator.setWeightCol(WEIGHT)
    return estimator.setWeightCol(COPIES) if COPIES in rows.columns else estimator


def _repeat(groups: DataFrame) -> bool:
    """Whether rows repeat so often that a pass over the groups per tree costs less than one over the rows for all."""
    found = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(COPIES), F.lit(0)).alias("rows")).first()
    return found["rows"] >= max(DRAWN_ROWS, DRAWN_SHARE * found["groups"])


def _to_fit(data: ModelData, family: TreeFamily) -> DataFrame:
    """The training rows in the form that the family is fitted on; a group weighs what its rows do."""
    if family.groups:
        return _groups(data, _cells(data, "train"), WEIGHT).withColumn(WEIGHT, F.col(WEIGHT) * F.col(COPIES))
    if family.drawn and _repeat(_cells(data, "train")):
        return _groups(data, _cells(data, "train"), WEIGHT)
    return data.train


def fit_depth(data: ModelData, family: TreeFamily, depth: int):
    """Fit one depth on the training rows."""
    return family.fit(_to_fit(data, family), depth, len(data.classes))


def fitted_depths(depths: Iterable[int]) -> list[tuple[int, int]]:
    """(requested, fitted) depths in the order asked for; Spark grows no tree beyond ``MAX_DEPTH``."""
    return [(d, min(d, MAX_DEPTH)) for d in dict.fromkeys(depths)]


def _accuracy(model, groups: DataFrame) -> float:
    return accuracy(model.transform(groups), LABEL, PREDICTION, COPIES).first()["accuracy"]


def _trees(model, depth: int) -> tuple[int, str] | None:
    """How deep the trees of a model are, and their digest; None where one is as deep as allowed, or they are too many."""
    parts = model.models if isinstance(model, (OneVsRestTrees, DrawnForest)) else [model]
    depths = [t.depth for part in parts for t in (part.trees if hasattr(part, "trees") else [part])]
    nodes = sum(part.totalNumNodes if hasattr(part, "trees") else part.numNodes for part in parts)
    if max(depths) >= depth or nodes > MAX_COMPARED:
        return None
    text = "".join(part.toDebugString.split("\n", 1)[1] for part in parts)  # the first line has the name of the fit
    return max(depths), hashlib.sha256(text.encode()).hexdigest()


def _fit_apart(depths: Sequence[int], fit: Callable[[list[int]], dict[int, tuple]]) -> dict[int, tuple]:
    """What ``fit`` finds per depth, with no fit between two depths that gave the same trees.

    Such trees have stopped growing by themselves: each depth between gives them too, and so does each
    limit below that none of them reaches. The last item of a result tells how deep its trees are
    and has their digest.
    """
    order = sorted(depths)
    found = fit(list(dict.fromkeys([*order[:1], *order[-1:]])))
    spans = [(0, len(order) - 1)]
    while spans:
        middles, narrower = [], []
        for low, high in spans:
            first, last = found[order[low]], found[order[high]]
            while last[-1] is not None and high - low > 1 and order[high - 1] > last[-1][0]:
                high -= 1
                found[order[high]] = last
            if high - low > 1 and first[-1] is not None and first[-1] == last[-1]:
                found.update({depth: last for depth in order[low + 1 : high]})
            elif high - low > 1:
                middle = (low + high) // 2
                middles.append(order[middle])
                narrower += [(low, middle), (middle, high)]
        if middles:
            found.update(fit(middles))
        spans = narrower
    return found


def depth_sweep(
    data: ModelData, family: TreeFamily, depths: Iterable[int], parallelism: int = 1
) -> DataFrame:
    """(model, depth, fitted_depth, train_accuracy, test_accuracy, fit_seconds) per requested depth.

    Depths beyond what Spark grows share one fit at its limit, and depths between two whose
    fits gave the same trees share one of these; each of their rows repeats its figures.
    """
    spark = data.train.sparkSession
    asked = fitted_depths(depths)
    rows = _to_fit(data, family)
    if rows is data.train:
        rows.persist(StorageLevel.MEMORY_AND_DISK)
    seen = _groups(data, _cells(data, "train")) if rows is data.train else rows
    held_out = _groups(data, _cells(data, "test"))

    def one_depth(depth: int):
        start = time.perf_counter()
        model = family.fit(rows, depth, len(data.classes))
        train, test = _accuracy(model, seen), _accuracy(model, held_out)
        return train, test, time.perf_counter() - start, _trees(model, depth)

    def fit(some: list[int]) -> dict[int, tuple]:
        return dict(zip(some, _each(spark, one_depth, some, parallelism)))

    found = _fit_apart(list({fitted for _, fitted in asked}), fit) if asked else {}
    return spark.createDataFrame(
        [(family.name, depth, fitted, *found[fitted][:-1]) for depth, fitted in asked],
        "model string, depth int, fitted_depth int, train_accuracy double, test_accuracy double, fit_seconds double",
    )


def _fold_weights(groups: DataFrame, folds: int) -> DataFrame:
    """(held_out, label_index, weight): balanced weights of the rows outside each fold.

    One aggregate; the driver sees one count per fold and class.
    """
    counts = groups.groupBy(FOLD, LABEL).agg(F.sum(COPIES).alias("n")).collect()
    weights = []
    for held_out in range(folds):
        outside: dict[float, int] = {}
        for row in counts:
            if row[FOLD] != held_out:
                outside[row[LABEL]] = outside.get(row[LABEL], 0) + row["n"]
        rows = sum(outside.values())
        weights += [(held_out, label, rows / (len(outside) * n)) for label, n in outside.items()]
    return groups.sparkSession.createDataFrame(
        weights, f"held_out int, {LABEL} double, {WEIGHT} double"
    )


def cv_scores(
    data: ModelData,
    family: TreeFamily,
    depths: Iterable[int],
    folds: int = 5,
    seed: int = 42,
    parallelism: int = 1,
) -> DataFrame:
    """(model, depth, fitted_depth, mean_accuracy, seconds) over stratified folds of the training rows.

    One row per requested depth; ``seconds`` is the sum over the folds. Depths between two whose
    fits gave the same trees in every fold share one of these.
    """
    spark = data.train.sparkSession
    rows = data.rows.where(F.col("_split") == "train").drop("_split")
    dealt = stratified_folds(rows, data.key, "_label", folds, seed, out=FOLD)
    same = [column(c) for c in data.cells.columns if c not in ("_split", COPIES)]
    groups = _groups(data, dealt.groupBy(FOLD, *same).agg(F.count(F.lit(1)).alias(COPIES)), FOLD)
    by_groups = family.groups or family.drawn and _repeat(groups)
    if not by_groups:
        dealt = data.encode(dealt).select(FOLD, LABEL, FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    weights = _fold_weights(groups, folds) if family.balanced else None
    parts = []
    for fold in range(folds):
        rows = (groups if by_groups else dealt).where(F.col(FOLD) != fold)
        if weights is not None:
            rows = rows.join(F.broadcast(weights.where(F.col("held_out") == fold)), LABEL).drop("held_out")
            if family.groups:
                rows = rows.withColumn(WEIGHT, F.col(WEIGHT) * F.col(COPIES))
        parts.append((rows, groups.where(F.col(FOLD) == fold)))

    def one_fit(item: tuple[int, int]):
        depth, fold = item
        start = time.perf_counter()
        rows, held_out = parts[fold]
        model = family.fit(rows, depth, len(data.classes))
        return _accuracy(model, held_out), time.perf_counter() - start, _trees(model, depth)

    def fit(some: list[int]) -> dict[int, tuple]:
        done = _each(spark, one_fit, [(d, f) for d in some for f in range(folds)], parallelism)
        return {d: _over_folds(done[i * folds : (i + 1) * folds]) for i, d in enumerate(some)}

    asked = fitted_depths(depths)
    try:
        found = _fit_apart(list({fitted for _, fitted in asked}), fit) if asked else {}
    finally:
        dealt.unpersist()
    return spark.createDataFrame(
        [(family.name, depth, fitted, *found[fitted][:-1]) for depth, fitted in asked],
        "model string, depth int, fitted_depth int, mean_accuracy double, seconds double",
    )


def _over_folds(done: list[tuple]) -> tuple:
    """Mean accuracy, sum of seconds, and the depth and digests of all folds, None where one has none."""
    scores, seconds, trees = zip(*done)
    return sum(scores) / len(scores), sum(seconds), None if None in trees else (max(depth for depth, _ in trees), trees)


@dataclass(frozen=True)
class GridSearch:
    scores: DataFrame
    best_depth: int
    model: object
    predictions: DataFrame  # test rows with label and predicted class names


def predict(data: ModelData, model, rows: DataFrame | None = None) -> DataFrame:
    """(key, label, predicted) with class names."""
    names = F.array(*[F.lit(c) for c in data.classes])
    found = model.transform(data.test if rows is None else rows)
    return found.select(
        column(data.key),
        F.get(names, F.col(LABEL).cast("int")).alias("label"),
        F.get(names, F.col(PREDICTION).cast("int")).alias("predicted"),
    )


def grid_search(
    data: ModelData,
    family: TreeFamily,
    depths: Iterable[int],
    folds: int = 5,
    seed: int = 42,
    parallelism: int = 1,
) -> GridSearch:
    """Best mean accuracy over the folds (ties: the smaller depth), refitted on all training rows."""
    scores = cv_scores(data, family, depths, folds, seed, parallelism)
    best = min(scores.collect(), key=lambda r: (-r["mean_accuracy"], r["depth"]))["depth"]
    model = fit_depth(data, family, best)
    return GridSearch(scores, best, model, predict(data, model))
