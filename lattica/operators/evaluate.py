"""Sampling, splits, classifiers, regressors and their metrics."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import perceptron
from .sample import lowest
from .search import nearest_rows

PERCENTS = (1, 3, 5, 10, 20, 30, 50, 80)
#: Names that a run may ask for, of which the last three look at neighbourhoods.
#: Boosted trees are MLlib's: gbt and gbt_reg, which the names of runs stand for too.
MODELS = ("nn", "rf", "xgboost", "mlp", "nn_reg", "rf_reg", "xgboost_reg", "mlp_reg", "spatial_mlp", "spatial_mlp_5x5", "unet")


def fold(key: Column, k: int, seed: int = 42) -> Column:
    """Fold of a row, by a hash: the same for any partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(k)).cast("int")


def quotas(sizes: DataFrame, total: int, mode: str, least: int = 50) -> DataFrame:
    """Rows to draw of each class (label, n): equal, sqrt or proportional shares; the last two at least 50."""
    w = {"equal": F.lit(1.0), "sqrt": F.sqrt("n"), "proportional": F.col("n").cast("double")}[mode]
    share = F.floor(w / F.sum(w).over(Window.partitionBy()) * total)
    return sizes.withColumn("quota", F.least(F.col("n"), share if mode == "equal" else F.greatest(share, F.lit(least))).cast("long"))


def stratified(rows: DataFrame, total: int, mode: str, key: str = "idx", seed: int = 42) -> DataFrame:
    """A sample by class, in the order of a hash of the key."""
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return lowest(rows, ["label"], quotas(sizes, total, mode).select("label", F.col("quota").alias("wanted")), key, seed)


def spatial_split(points: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """Points (idx, lat, lon) with split: train if in a training box, else test if in a test box; others go."""

    packed = lambda boxes, name: boxes.agg(F.collect_list(F.struct("south", "west", "north", "east")).alias(name))
    both = packed(train, "train").crossJoin(packed(test, "test"))  # boxes are drawn by hand: one row
    hit = lambda name: F.exists(name, lambda b: F.col("lat").between(b["south"], b["north"]) & F.col("lon").between(b["west"], b["east"]))
    split = F.when(hit("train"), "train").when(hit("test"), "test")
    return points.crossJoin(F.broadcast(both)).withColumn("split", split).drop("train", "test").where("split is not null")


def knn(train: DataFrame, test: DataFrame, k: int = 5, regression: str | None = None) -> DataFrame:
    """Prediction of each test row (idx, emb) by its k nearest training rows: the commonest label, or a mean.

    Ties of distance go to the smaller idx, ties of votes to the smaller label.
    """
    target = regression or "label"
    near = nearest_rows(train.select("idx", "emb", F.col(target).cast("double").alias("target")), test.select("idx", "emb"), k, "target")
    kept = near.select(F.col("source").alias("test_idx"), "target" if regression else F.col("target").cast(train.schema[target].dataType).alias("target"))
    if regression:
        return kept.groupBy("test_idx").agg(F.avg("target").alias("prediction")).withColumnRenamed("test_idx", "idx")
    votes = kept.groupBy("test_idx", "target").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("test_idx").agg(F.min_by("target", F.struct(-F.col("votes"), "target")).alias("prediction")).withColumnRenamed("test_idx", "idx")


def confusion(predicted: DataFrame) -> DataFrame:
    """Counts by label and prediction, and their share of the label's row in percent."""
    n = predicted.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("row_pct", F.col("n") / F.sum("n").over(Window.partitionBy("label")) * 100)


def class_scores(predicted: DataFrame) -> DataFrame:
    """Support, precision, recall and F1 of each class seen as label or prediction; 0 where undefined."""
    each = predicted.select(F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.lit(1).alias("actual"), F.lit(0).alias("claimed"), (F.col("label") == F.col("prediction")).cast("int").alias("hit")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).alias("actual"), F.lit(1).alias("claimed"), F.lit(0).alias("hit")),
    )))
    s = each.groupBy("class").agg(F.sum("actual").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hit").alias("hits"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return s.select(
        "class", "support", ratio(F.col("hits"), F.col("claimed")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("claimed") + F.col("support")).alias("f1"),
    )


def f1_summary(predicted: DataFrame) -> DataFrame:
    """Macro F1 over classes with support, F1 weighted by support, and accuracy."""
    s = class_scores(predicted).where("support > 0")
    accuracy = predicted.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))
    return s.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1")).crossJoin(accuracy)


def regression_scores(predicted: DataFrame) -> DataFrame:
    """R2, RMSE and MAE of target and prediction."""
    error = F.col("target") - F.col("prediction")
    n, sse = F.count(F.lit(1)), F.sum(error * error)
    sst = F.var_pop("target") * n
    return predicted.agg((1 - sse / sst).alias("r2"), F.sqrt(sse / n).alias("rmse"), F.avg(F.abs(error)).alias("mae"))


def model_of(name: str, classes: int, inputs: int, **params):
    """The estimator that a run's model name stands for."""
    if name == "rf":
        return RandomForestClassifier(numTrees=params.get("n_estimators", 100), maxDepth=min(30, params.get("max_depth") or 12), seed=42)
    if name in ("gbt", "xgboost"):
        one = GBTClassifier(maxIter=params.get("n_estimators", 20), maxDepth=params.get("max_depth", 6), stepSize=params.get("learning_rate", 0.3), seed=42)
        return OneVsRest(classifier=one, parallelism=4)
    if name == "mlp":
        return MultilayerPerceptronClassifier(layers=[inputs, *params.get("hidden", (64, 32)), classes], maxIter=params.get("max_iter", 200), seed=42)
    if name == "rf_reg":
        return RandomForestRegressor(numTrees=params.get("n_estimators", 100), maxDepth=min(30, params.get("max_depth") or 12), seed=42)
    if name in ("gbt_reg", "xgboost_reg"):
        return GBTRegressor(maxIter=params.get("n_estimators", 20), maxDepth=params.get("max_depth", 6), stepSize=params.get("learning_rate", 0.3), seed=42)
    raise ValueError(f"no model named {name}")


def fit_predict(name: str, train: DataFrame, test: DataFrame, target: str = "label", **params) -> DataFrame:
    """Test rows with a prediction of a named model; nn and nn_reg are exact neighbours."""
    if name in ("nn", "nn_reg"):
        found = knn(train, test, params.get("n_neighbors", 5), target if name == "nn_reg" else None)
        return test.join(found, "idx")
    if name == "mlp_reg":
        fitted = perceptron.fit(train, target, tuple(params.get("hidden", (64, 32))), params.get("max_iter", 100), params.get("alpha", 1e-4))
        return test.join(fitted(test.select("idx", "emb")).select("idx", "prediction"), "idx")
    inputs = len(train.select("emb").first()["emb"])
    classes = int(train.agg(F.max(target)).first()[0]) + 1 if not name.endswith("_reg") else 1
    ready = lambda df: df.withColumns({"features": array_to_vector("emb"), "label": F.col(target).cast("double")})
    out = model_of(name, classes, inputs, **params).fit(ready(train)).transform(ready(test))
    kept = F.col("prediction") if name.endswith("_reg") else F.col("prediction").cast("int").alias("prediction")
    return test.join(out.select("idx", kept), "idx")


def learning_curve(rows: DataFrame, names: tuple[str, ...] = ("nn",), percents: tuple[int, ...] = PERCENTS, cap: int = 200_000) -> Iterator[tuple[int, str, DataFrame]]:
    """For each share of the training fold and each model: percent, name, scores on the test fold of ``cap`` rows at most."""
    split = rows.withColumn("fold", fold(F.col("idx"), 5))
    pool, test = split.where("fold > 0"), split.where("fold = 0").orderBy(F.xxhash64("idx"), "idx").limit(cap)
    n = pool.count()
    for percent in percents:
        train = stratified(pool, max(1, n * percent // 100), "proportional", seed=percent)
        for name in names:
            yield percent, name, f1_summary(fit_predict(name, train, test))


def cross_validated(rows: DataFrame, name: str, k: int = 5, seed: int = 42, target: str = "label", folds: Column | None = None) -> DataFrame:
    """Predictions for all rows, each by a model of the other folds; ``folds`` (0 to k - 1) in place of those by hash."""
    split = rows.withColumn("fold", fold(F.col("idx"), k, seed) if folds is None else folds)
    parts = [fit_predict(name, split.where(F.col("fold") != i), split.where(F.col("fold") == i), target) for i in range(k)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def field_profile(truth: DataFrame, field: str) -> DataFrame:
    """Rows, filled rows and distinct values of an attribute."""
    x = F.col(field)
    return truth.agg(F.count(F.lit(1)).alias("total"), F.count(x).alias("non_null"), F.count_distinct(x).alias("unique_count"))


def class_counts(truth: DataFrame, field: str, least: int = 50) -> DataFrame:
    """Rows of each value, most first, and whether there are too few."""
    n = truth.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("excluded", F.col("n") < least).orderBy(F.desc("n"), "class")


def field_type(truth: DataFrame, field: str, most: int = 20) -> str:
    """Classification for text, and for numbers of few whole values; else regression."""
    if dict(truth.dtypes)[field] == "string":
        return "classification"
    x = F.col(field)
    n, whole = truth.agg(F.count_distinct(x), F.min(F.coalesce(x == F.floor(x), F.lit(True)))).first()
    return "classification" if n <= most and whole else "regression"


def check_config(config: dict) -> list[str]:
    """What is wrong with an evaluation's configuration."""
    wrong = [f"missing {k}" for k in ("$schema", "shapefile", "fields") if not config.get(k)]
    wrong += ["a field has no name" for f in config.get("fields") or () if not f.get("name")]
    for name in config.get("classifiers") or {}:
        if name not in (*MODELS, "gbt", "gbt_reg"):
            wrong.append(f"unknown model {name}")
        elif name in MODELS[-3:]:
            wrong.append(f"{name} needs neighbourhoods")
    return wrong


def variants(params: dict[str, list[dict] | dict]) -> dict[str, dict]:
    """One name for each set of parameters of a model: name_v1, name_v2 where there are several."""
    out = {}
    for name, sets in params.items():
        if isinstance(sets, dict):
            out[name] = sets
        else:
            out |= {f"{name}_v{i}": p for i, p in enumerate(sets, 1)}
    return out


def dry_run(truth: DataFrame, fields: list[dict], years: list[int], models: list[str], kfold: int = 5) -> list[dict]:
    """An event for each year and field; a field that is not there gives an error, and the rest goes on."""
    events: list[dict] = []
    for year in years:
        for f in fields:
            if f["name"] not in truth.columns:
                events.append({"event": "error", "field": f["name"], "year": year})
                continue
            total, _, unique = field_profile(truth, f["name"]).first()
            events.append({"event": "dry_run", "field": f["name"], "year": year, "type": f.get("type") or field_type(truth, f["name"]), "unique_values": unique, "features": total, "models": models, "kfold": kfold})
    return events


def sample_hint(most: int, total: int) -> float:
    """Share of the rows that a cap leaves, in percent."""
    return 0.0 if total <= 0 else round(min(100.0, 100.0 * most / total), 1)


def plot_range(predicted: DataFrame) -> DataFrame:
    """Shared range of targets and predictions, 5 % wider, or by 1 where it is a point."""
    r = predicted.agg(F.least(F.min("target"), F.min("prediction")).alias("low"), F.greatest(F.max("target"), F.max("prediction")).alias("high"))
    pad = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) * 0.05).otherwise(1.0)
    return r.select((F.col("low") - pad).alias("low"), (F.col("high") + pad).alias("high"))


def result_table(scores: DataFrame, models: list[str]) -> DataFrame:
    """One row per percent, one column per model."""
    return scores.groupBy("pct").pivot("model", models).agg(F.first("score"))
