"""Model training with pyspark.ml: boosting, voting, calibration, sweeps, neighbours."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlguard import fixed_values as fv
from urlguard.functions.urls import to_binary
from urlguard.operators.lookup import lookup
from urlguard.operators.timelines import in_slices, runs
from urlguard.session import new_folder

SEED = 42
FOLDS = 5


def training_rows(df: DataFrame, key: str, names=fv.VECTOR_NAMES) -> DataFrame:
    """(key, features, label) with label 1 = phishing, from signed labels."""
    vectors = VectorAssembler(inputCols=list(names), outputCol="features").transform(df)
    return vectors.select(key, "features", to_binary(F.col("label")).cast("double").alias("label"))


# --- fixed values: the estimators and their settings -------------------------------------


def boosted(trees: int = 200, depth: int = 5, rate: float = 0.1, **more) -> GBTClassifier:
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, seed=SEED, **more)


def reference_gbt(trees: int = 200) -> GBTClassifier:
    return boosted(trees, 5, 0.1, minInstancesPerNode=5, subsamplingRate=0.8)


def vote_members(scale: float = 1.0) -> list:
    """The three voters; ``scale`` shortens them for trial runs."""
    def trees(n: int) -> int:
        return max(1, round(n * scale))

    return [
        boosted(trees(150), 5, 0.1),
        RandomForestClassifier(numTrees=trees(150), maxDepth=8, seed=SEED),
        boosted(trees(100), 4, 0.1),
    ]


def zoo(trees: int = 100) -> dict:
    """The classifiers that are compared with each other."""
    return {
        "logistic_regression": LogisticRegression(),
        "decision_tree": DecisionTreeClassifier(maxDepth=30, seed=SEED),
        "random_forest": RandomForestClassifier(numTrees=10, seed=SEED),
        "gradient_boosting": boosted(trees, 4, 0.7),
        "naive_bayes": NaiveBayes(modelType="gaussian"),
        "linear_svm": LinearSVC(),
        "perceptron": MultilayerPerceptronClassifier(
            layers=[len(fv.VECTOR_NAMES), 100, 2], seed=SEED
        ),
    }


# ------------------------------------------------------------------ scores


@dataclass
class VoteModel:
    """Mean phishing probability of one or more fitted classifiers."""

    members: list[Model]

    def transform(self, df: DataFrame, score: str = "score") -> DataFrame:
        rows, parts = df, []
        for k, member in enumerate(self.members):
            raw, prob, pred = f"_raw{k}", f"_prob{k}", f"_pred{k}"
            member = member.copy()
            member.setRawPredictionCol(raw).setProbabilityCol(prob).setPredictionCol(pred)
            rows = member.transform(rows)
            parts.append(vector_to_array(F.col(prob))[1])
        mean = sum(parts[1:], parts[0]) / len(parts)
        return rows.withColumn(score, mean).select(*df.columns, score)


def fit_vote(df: DataFrame, estimators: list) -> VoteModel:
    """Fits each estimator on the same rows."""
    return VoteModel([e.fit(df) for e in estimators])


def fold_of(key: str, folds: int) -> Column:
    """Fold of a row by the hash of its key: the same on every run."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(folds)).cast("int")


BLOCK = "low double, high double, weight double, total double"


def pooled(low: np.ndarray, high: np.ndarray, weight: np.ndarray, total: np.ndarray) -> list[tuple]:
    """Neighbouring blocks of scores pooled until their means rise (pool adjacent violators)."""
    kept: list[tuple] = []
    for block in zip(low.tolist(), high.tolist(), weight.tolist(), total.tolist()):
        while kept and kept[-1][3] * block[2] >= block[3] * kept[-1][2]:
            first = kept.pop()
            block = (first[0], block[1], first[2] + block[2], first[3] + block[3])
        kept.append(block)
    return kept


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pools each run of rows with the same group; rows come sorted by group and score."""
    for (group,), columns in runs(batches, 1):
        blocks = pooled(*columns)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(blocks), group, np.int64)), *(pa.array(c, pa.float64()) for c in zip(*blocks))],
            ["_slice", "low", "high", "weight", "total"],
        )


def isotonic_blocks(scored: DataFrame, fanout: int = 64, levels: int = 2) -> DataFrame:
    """(low, high, weight, total): blocks of scores that an isotonic fit of label on score keeps together.

    Ranges of scores are pooled by themselves, then ``fanout`` neighbouring ranges together, ``levels``
    times. Pooling is exact in any order of merging, so what remains has the fit of all rows; only
    blocks whose means rise are left.
    """
    merged = scored.groupBy(F.col("score").alias("low")).agg(
        F.col("low").alias("high"), F.count("*").cast("double").alias("weight"), F.sum("label").cast("double").alias("total")
    )
    blocks = in_slices(merged, "low")
    for level in range(levels + 1):
        group = F.floor(F.col("_slice") / (fanout if level else 1)).alias("_slice")
        dealt = blocks.select(group, "low", "high", "weight", "total")
        blocks = dealt.repartition("_slice").sortWithinPartitions("_slice", "low").mapInArrow(_pool, f"_slice long, {BLOCK}")
    return blocks.drop("_slice")


def fit_isotonic(scored: DataFrame) -> IsotonicRegressionModel:
    """Isotonic fit of label on score, from pooled blocks: each one's first and last score share its weight."""
    ends = F.when(F.col("low") == F.col("high"), F.array("low")).otherwise(F.array("low", "high"))
    points = isotonic_blocks(scored).select(
        F.explode(ends).alias("score"), (F.col("total") / F.col("weight")).alias("label"), (F.col("weight") / F.size(ends)).alias("weight")
    )
    return IsotonicRegression(
        featuresCol="score", labelCol="label", weightCol="weight", predictionCol="calibrated"
    ).fit(points)


@dataclass
class CalibratedModel:
    """Mean over folds of isotonic(score) with cross-fitted pairs."""

    pairs: list[tuple[VoteModel, IsotonicRegressionModel]]
    metadata: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, p: str = "p") -> DataFrame:
        rows, names = df, []
        for k, (model, isotonic) in enumerate(self.pairs):
            names.append(f"_c{k}")
            scored = model.transform(rows, "score")
            rows = isotonic.transform(scored).withColumnRenamed("calibrated", names[-1]).drop("score")
        mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
        clipped = F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0))
        return rows.withColumn(p, clipped).select(*df.columns, p)


def calibrate(df: DataFrame, estimators: list, key: str, folds: int = FOLDS) -> CalibratedModel:
    """Fits on all folds but one, calibrates on the one left out, for every fold."""
    rows = df.withColumn("_fold", fold_of(key, folds)).cache()

    def fitted(k: int) -> tuple[VoteModel, IsotonicRegressionModel]:
        model = fit_vote(rows.filter(F.col("_fold") != k), estimators)
        return model, fit_isotonic(model.transform(rows.filter(F.col("_fold") == k)))

    with ThreadPoolExecutor(folds) as pool:  # a tree's jobs are small: folds wait for the driver, not for cores
        pairs = list(pool.map(fitted, range(folds)))
    rows.unpersist()
    return CalibratedModel(pairs, {"is_calibrated": True, "method": "isotonic", "folds": folds})


def score(df: DataFrame, model: CalibratedModel, names=fv.VECTOR_NAMES) -> DataFrame:
    """Adds ``p``, the calibrated phishing probability, and ``score`` = 100 p."""
    vectors = VectorAssembler(inputCols=list(names), outputCol="features").transform(df)
    return model.transform(vectors).drop("features").withColumn("score", F.col("p") * 100)


def predictions(df: DataFrame, p: str = "p") -> DataFrame:
    """(y_true, y_prob, prediction) of scored rows, for the metric operators."""
    return df.select(
        F.col("label").cast("int").alias("y_true"),
        F.col(p).alias("y_prob"),
        (F.col(p) >= 0.5).cast("int").alias("prediction"),
    )


# ------------------------------------------------------------------ storage


def save_model(model: CalibratedModel, path: str, spark: SparkSession) -> None:
    """Saves every member and a JSON side table with the metadata."""
    plan = []
    for k, (vote, isotonic) in enumerate(model.pairs):
        isotonic.write().overwrite().save(f"{path}/pair-{k}/isotonic")
        PipelineModel(vote.members).write().overwrite().save(f"{path}/pair-{k}/vote")
        plan.append(k)
    meta = {**model.metadata, "pairs": len(plan), "feature_names": list(fv.VECTOR_NAMES)}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/metadata")


def load_model(path: str, spark: SparkSession) -> CalibratedModel:
    """Loads a saved model; refuses one that is not flagged as calibrated."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    if meta.get("is_calibrated") is not True:
        raise ValueError("the model is not calibrated")
    pairs = [
        (
            VoteModel(PipelineModel.load(f"{path}/pair-{k}/vote").stages),
            IsotonicRegressionModel.load(f"{path}/pair-{k}/isotonic"),
        )
        for k in range(meta["pairs"])
    ]
    return CalibratedModel(pairs, meta)


# ------------------------------------------------------------------ comparisons


def train_zoo(train: DataFrame, test: DataFrame, estimators: dict) -> DataFrame:
    """Test predictions (model, y_true, prediction) of every classifier."""
    frames = []
    for name, estimator in estimators.items():
        scored = estimator.fit(train).transform(test)
        frames.append(
            scored.select(
                F.lit(name).alias("model"),
                F.col("label").cast("int").alias("y_true"),
                F.col("prediction").cast("int").alias("prediction"),
            )
        )
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


FITS = 9  # fits that run side by side: their jobs are small and wait for the driver
FIT_ROWS = 50_000  # rows that a task of a fit reads, about


def in_folds(df: DataFrame, key: str, folds: int, alike: bool) -> DataFrame:
    """(fold, features, label, n), written once; ``alike`` joins rows of a fold with equal features and label to one of weight n."""
    rows = df.select(fold_of(key, folds).alias("fold"), "features", "label")
    if alike:
        rows = rows.groupBy("fold", "features", "label").agg(F.count("*").cast("double").alias("n"))
    else:
        rows = rows.withColumn("n", F.lit(1.0))
    return written(df.sparkSession, rows.repartition(-(-max(1, df.count()) // FIT_ROWS)))


def sweep(
    df: DataFrame, estimator, grid: dict, parallelism: int = FITS, folds: int = 0, key: str = "page_id", alike: bool = False
) -> DataFrame:
    """Accuracy of every combination of parameter values, on a held-out fifth or over folds.

    Fits of all combinations and folds run side by side. With ``alike``, rows that are alike are fitted
    as one weighted row: the same fit for an estimator that draws no rows, and fewer rows in each of its passes.
    """
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    maps = builder.build()
    rows = in_folds(df, key, folds or FOLDS, alike)
    estimator = estimator.copy()
    estimator.setWeightCol("n")
    evaluator = MulticlassClassificationEvaluator(metricName="accuracy", weightCol="n")

    def accuracy(fit: tuple[dict, int]) -> float:
        chosen, fold = fit
        model = estimator.fit(rows.filter(F.col("fold") != fold), chosen)
        return evaluator.evaluate(model.transform(rows.filter(F.col("fold") == fold)))

    tried = range(folds or 1)
    with ThreadPoolExecutor(parallelism) as pool:
        found = np.array(list(pool.map(accuracy, [(m, k) for m in maps for k in tried]))).reshape(len(maps), len(tried))
    table = [
        (json.dumps({p.name: v for p, v in m.items()}, sort_keys=True), float(a))
        for m, a in zip(maps, found.mean(axis=1))
    ]
    return df.sparkSession.createDataFrame(table, "params string, accuracy double")


def importances(model: Model, spark: SparkSession, names=fv.VECTOR_NAMES) -> DataFrame:
    """Features by importance, most important first."""
    rows = list(zip(names, map(float, model.featureImportances.toArray())))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


# ------------------------------------------------------------------ neighbours


def collapse_vectors(df: DataFrame, names) -> DataFrame:
    """Distinct vectors with their rows and phishing rows: three-valued columns repeat a lot."""
    return df.groupBy(*names).agg(
        F.count("*").alias("n"), F.sum(F.col("label").cast("int")).alias("phishing")
    )


NEAREST = "v array<int>, d long, n long, phishing long"
ASKED_ROWS = 1_000
TOGETHER = 64  # vectors whose distances are one matrix


def in_blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Vectors in lexicographic order with the number of their block, about ``rows`` each."""
    sliced = in_slices(vectors, "v")
    sizes = sliced.groupBy("_slice").agg(F.count("*").alias("_size"))
    nth = F.row_number().over(Window.partitionBy("_slice").orderBy("v")) - 1
    return lookup(sliced, sizes, "_slice").select(
        *vectors.columns, F.struct("_slice", F.floor(nth / rows).alias("part")).alias("block")
    )


def boxes(blocked: DataFrame, dims: int, side: str) -> DataFrame:
    """(block, low, high, rows): the least and the largest value of each component in a block."""
    ends = [F.array(*[f(F.col("v")[k]) for k in range(dims)]) for f in (F.min, F.max)]
    return blocked.groupBy("block").agg(ends[0].alias(f"{side}_low"), ends[1].alias(f"{side}_high")).withColumnRenamed("block", side)


def block_pairs(asked: DataFrame, points: DataFrame, dims: int) -> DataFrame:
    """(asked, points, apart): pairs of blocks with the least squared distance their boxes allow.

    One row for each pair of blocks, not of rows.
    """
    all_points = boxes(points, dims, "points").agg(F.collect_list(F.struct("points", "points_low", "points_high")).alias("p"))
    pairs = boxes(asked, dims, "asked").withColumn("p", F.explode(all_points.scalar())).select("asked", "asked_low", "asked_high", "p.*")
    gap = F.zip_with(
        F.zip_with("points_low", "asked_high", lambda a, b: a - b), F.zip_with("asked_low", "points_high", lambda a, b: a - b),
        lambda a, b: F.greatest(a, b, F.lit(0)),
    )
    return pairs.select("asked", "points", F.aggregate(gap, F.lit(0).cast("long"), lambda s, g: s + g * g).alias("apart"))


def met(pairs: DataFrame, asked: DataFrame, points: DataFrame, most: int) -> DataFrame:
    """For each vector asked about, the nearest distances with their rows in each paired block."""
    zero = F.lit(0).cast("long")
    left = pairs.join(asked.withColumnRenamed("block", "asked"), "asked").select("asked", "points", F.lit(False).alias("is_point"), "v", zero.alias("n"), zero.alias("phishing"))
    right = pairs.join(points.withColumnRenamed("block", "points"), "points").select("asked", "points", F.lit(True).alias("is_point"), "v", "n", "phishing")
    dealt = left.unionAll(right).repartition("asked", "points").sortWithinPartitions("asked", "points", "is_point")
    key = F.concat_ws("/", *[F.col(f"{side}.{part}").cast("string") for side in ("asked", "points") for part in ("_slice", "part")])
    return dealt.select(key.alias("pair"), "is_point", "v", "n", "phishing").mapInArrow(_nearest(most), NEAREST)


def certain_pairs(pairs: DataFrame, asked: DataFrame, points: DataFrame, most: int) -> DataFrame:
    """The pairs of blocks that may hold one of the ``most`` nearest rows of a vector asked about.

    Every block of vectors first meets the block of points nearest to it. The distance at which the last of
    its vectors has enough rows there bounds what can count: blocks of points farther away are passed over.
    """
    home = pairs.groupBy("asked").agg(F.min_by("points", F.struct("apart", "points")).alias("points"))
    first = met(home, asked, points, most)
    nearer = Window.partitionBy("v").orderBy("d")
    enough = first.withColumn("upto", F.sum("n").over(nearer)).groupBy("v").agg(F.min(F.when(F.col("upto") >= most, F.col("d"))).alias("reach"))
    reach = lookup(asked, enough, "v").groupBy(F.col("block").alias("asked")).agg(
        F.when(F.count("*") == F.count("reach"), F.max("reach")).alias("reach")
    )
    return lookup(pairs, reach, "asked").filter(F.col("reach").isNull() | (F.col("apart") <= F.col("reach"))).select("asked", "points")


def knn_vote(
    train: DataFrame, test: DataFrame, names, key: str, ks: list[int], block_rows: int = 50_000, asked_rows: int = ASKED_ROWS
) -> DataFrame:
    """(key, label, k, prediction) by majority of the k nearest training rows, exact.

    Both sides are collapsed to distinct vectors and cut into blocks in lexicographic order. Pairs of
    blocks whose boxes are too far apart to hold a neighbour are never compared. A task gets one
    block of each side and returns, for a vector asked about, its nearest distances with their rows:
    at most max(ks) of them. So what is merged grows with the vectors asked, not with pairs.
    """
    names, most = list(names), max(ks)
    vector = F.array(*[F.col(c).cast("int") for c in names])
    spark = train.sparkSession
    points = written(spark, in_blocks(collapse_vectors(train, names).select(vector.alias("v"), "n", "phishing"), block_rows))
    asked = written(spark, in_blocks(test.select(vector.alias("v")).distinct(), asked_rows))
    pairs = written(spark, block_pairs(asked, points, len(names)))
    found = met(written(spark, certain_pairs(pairs, asked, points, most)), asked, points, most)
    zero = F.lit(0).cast("long")
    merged = found.groupBy("v", "d").agg(F.sum("n").alias("n"), F.sum("phishing").alias("phishing"))
    nearer = Window.partitionBy("v").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    merged = merged.withColumn("before", F.coalesce(F.sum("n").over(nearer), zero)).filter(F.col("before") < most)
    best = merged.groupBy("v").agg(F.collect_list(F.struct("n", "phishing", "before")).alias("best"))
    rows = lookup(test.select(key, "label", vector.alias("v")), best, "v").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    # The vote weighs the rows within the first k; rows at one distance share their place.
    share = F.expr(
        "aggregate(best, 0D, (s, x) -> s + greatest(least(x.n, k - x.before), 0) * x.phishing / x.n)"
    )
    # A tie is not a majority; the margin keeps rounding of the shares out of it.
    return rows.select(
        key, "label", "k", F.coalesce((share * 2 > F.col("k") + 1e-9).cast("int"), F.lit(0)).alias("prediction")
    )


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Writes rows to the work folder and reads them back."""
    path = new_folder(spark, "vectors")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def nearest_cells(asked: np.ndarray, points: np.ndarray, n: np.ndarray, phishing: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Of each vector the nearest distances that hold ``most`` rows: (row, distance, rows, phishing rows)."""
    distance = np.square(asked).sum(1)[:, None] + np.square(points).sum(1) - 2 * asked @ points.T
    if distance.shape[1] > most:  # all as near as the last that can count
        near = distance <= np.partition(distance, most - 1, axis=1)[:, most - 1 : most]
    else:
        near = np.ones(distance.shape, bool)
    row, column = np.nonzero(near)
    cells, group = np.unique(row * (distance.max() + 1) + distance[near], return_inverse=True)
    rows, hits = (np.bincount(group, weights=w[column]).astype(np.int64) for w in (n, phishing))
    owner, at = np.divmod(cells, distance.max() + 1)
    first = np.searchsorted(owner, owner)  # first cell of the same vector
    before = np.cumsum(rows) - rows
    keep = before - before[first] < most
    return owner[keep], at[keep], rows[keep], hits[keep]


def _nearest(most: int):
    """Of each pair of blocks the nearest distances of every vector asked about; rows come sorted by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (is_point, vectors, n, phishing) in runs(batches, 1):
            is_point = is_point.astype(bool)
            if is_point.all() or not is_point.any():
                continue
            vectors = np.stack(vectors).astype(np.int64)
            asked, points = vectors[~is_point], vectors[is_point]
            for start in range(0, len(asked), TOGETHER):
                part = asked[start : start + TOGETHER]
                owner, at, rows, hits = nearest_cells(part, points, n[is_point], phishing[is_point], most)
                own = pa.array(part[owner].astype(np.int32).tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([own, *map(pa.array, (at, rows, hits))], ["v", "d", "n", "phishing"])

    return run


# ------------------------------------------------------------------ intervals

NOISY_ROWS = 1_000  # rows whose noisy copies are held at once


def confidence_interval(
    df: DataFrame, key: str, p: str = "p", n: int = 100, sigma: float = 0.02, seed: int = SEED
) -> DataFrame:
    """Adds ``lower`` and ``upper``: the 2.5 and 97.5 percentiles of n noisy copies of p.

    The noise is drawn from sha2 of (seed, key, copies), four copies from one hash, so a task that
    runs again, or another engine, gives the same interval, and no copy leaves its row: there is no shuffle.
    Copies are made and partly sorted for many rows at once.
    """
    ends = [str(i).encode() for i in range((n - 1) // 4 + 1)]
    places = [(int(q * (n - 1)), min(int(q * (n - 1)) + 1, n - 1), q * (n - 1) - int(q * (n - 1))) for q in (0.025, 0.975)]
    kth = sorted({place for low, high, _ in places for place in (low, high)})

    def intervals(names: pa.Array, centres: pa.Array) -> list[np.ndarray]:
        prefixes = [f"{name}:".encode() for name in names.to_pylist()]
        digests = b"".join([hashlib.sha256(prefix + end).digest() for prefix in prefixes for end in ends])
        drawn = np.frombuffer(digests, ">u4").reshape(len(prefixes), -1, 2)[:, :n].astype(np.float64)
        noise = np.sqrt(-2 * np.log((drawn[:, :, 0] + 1) / 4294967297.0)) * np.cos(2 * np.pi * drawn[:, :, 1] / 4294967296.0)
        # A missing centre counts as 1, as least() and greatest() have it.
        centre = centres.to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
        copies = np.fmax(0.0, np.fmin(1.0, centre + sigma * noise))
        copies.partition(kth, axis=1)
        return [copies[:, low] + (copies[:, high] - copies[:, low]) * part for low, high, part in places]

    @F.arrow_udf("struct<lower: double, upper: double>")
    def interval(names: pa.Array, centres: pa.Array) -> pa.Array:
        found = [intervals(names[k : k + NOISY_ROWS], centres[k : k + NOISY_ROWS]) for k in range(0, len(names), NOISY_ROWS)]
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0)] * 2
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["lower", "upper"])

    named = F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))
    found = df.withColumn("_interval", interval(named, F.col(p).cast("double")))
    return found.withColumns({"lower": F.col("_interval.lower"), "upper": F.col("_interval.upper")}).drop("_interval")
