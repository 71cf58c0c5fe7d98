"""Score and preference models on feature tables, with Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.functions.ranks import global_row_number, quantiles
from lumenrank.functions.shuffles import shuffled
from lumenrank.operators.analysis import feature_columns
from lumenrank.operators.forest import DeepForest, DeepForestModel
from lumenrank.operators.metrics import conformal, ensemble, ranking_metrics, regression_metrics
from lumenrank.operators.splits import training_frame
from lumenrank.plans.stages import cut


@dataclass
class Scaler:
    """Medians for missing values, and means and population deviations, of the training rows."""

    columns: list[str]
    median: list[float]
    mean: list[float]
    std: list[float]

    @classmethod
    def fit(cls, train: DataFrame, columns: list[str]) -> Scaler:
        found = quantiles(train, columns, [0.5])
        middle = [found[c][0] or 0.0 for c in columns]
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(float(m))) for c, m in zip(columns, middle, strict=True)]
        stats = train.agg(*[F.avg(x) for x in filled], *[F.stddev_pop(x) for x in filled]).first()
        n = len(columns)
        return cls(columns, [float(m) for m in middle], [float(x or 0) for x in stats[:n]], [float(x) if x else 1.0 for x in stats[n:]])

    def scaled(self) -> list[Column]:
        return [(F.coalesce(F.col(c).cast("double"), F.lit(m)) - mu) / s for c, m, mu, s in zip(self.columns, self.median, self.mean, self.std, strict=True)]

    def assemble(self, df: DataFrame, name: str = "_x") -> DataFrame:
        own = [f"_s{i}" for i in range(len(self.columns))]
        wide = df.withColumns(dict(zip(own, self.scaled(), strict=True)))
        return VectorAssembler(inputCols=own, outputCol=name).transform(wide).drop(*own)


@dataclass
class Fitted:
    """A regressor with its scaler."""

    kind: str
    scaler: Scaler
    model: Model | DeepForestModel

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        return self.model.transform(self.scaler.assemble(df)).withColumnRenamed("prediction", name).drop("_x")


def _elastic_net(train: DataFrame, target: str) -> LinearRegression:
    """Penalty 0.05 with 30 % absolute values. Spark divides the squared part by the label's deviation, so it is multiplied here."""
    strength, share = 0.05, 0.3
    spread = train.agg(F.stddev_pop(target)).first()[0] or 1.0
    total = strength * share + spread * strength * (1 - share)
    return LinearRegression(featuresCol="_x", labelCol=target, regParam=total, elasticNetParam=strength * share / total, standardization=False, maxIter=1000, tol=1e-9)


REGRESSORS: dict[str, Callable[[DataFrame, str], object]] = {
    "elasticnet": _elastic_net,
    "random_forest": lambda train, y: DeepForest(featuresCol="_x", labelCol=y, numTrees=300, minInstancesPerNode=2, maxDepth=30, seed=42),
    "gbt": lambda train, y: GBTRegressor(featuresCol="_x", labelCol=y, maxDepth=4, maxIter=100, stepSize=0.1, seed=42),
}


def fit_regressor(kind: str, train: DataFrame, columns: list[str], target: str, estimator: object | None = None) -> Fitted:
    """Fit on training rows only; estimator overrides the kind's own settings."""
    scaler = Scaler.fit(train, columns)
    ready = scaler.assemble(train.filter(F.col(target).isNotNull())).withColumn(target, F.col(target).cast("double"))
    return Fitted(kind, scaler, (estimator or REGRESSORS[kind](train, target)).fit(ready))


@dataclass
class Run:
    """What a training run leaves: models, predictions (model, role, image_id, y, p), metrics, widths, ensemble."""

    models: dict[str, Fitted]
    predictions: DataFrame
    metrics: DataFrame
    half_widths: DataFrame
    ensemble: DataFrame
    pairwise: dict[str, object] = field(default_factory=dict)


def train_baseline(features: DataFrame, labels: DataFrame, splits: DataFrame, pairs: DataFrame | None = None, target: str = "mean_score", holdout: int = 0, kinds: tuple[str, ...] = ("elasticnet", "random_forest", "gbt"), estimators: dict[str, object] | None = None) -> Run:
    """Fit each kind on the train rows and judge it on the val and test rows."""
    columns = feature_columns(features)
    frame = cut(training_frame(features, labels, splits, target, holdout), "frame")
    train = frame.filter("role = 'train'")
    models = {k: fit_regressor(k, train, columns, target, (estimators or {}).get(k)) for k in kinds}
    judged = None
    for k, m in models.items():
        one = m.predict(frame.filter("role <> 'train'")).select(F.lit(k).alias("model"), "role", "image_id", F.col(target).cast("double").alias("y"), "p")
        judged = one if judged is None else judged.unionByName(one)
    judged = cut(judged, "judged")
    val = judged.filter("role = 'val'")
    run = Run(models, judged, regression_metrics(judged, by=["model", "role"]), conformal(val, by=["model"]), ensemble(val))
    if pairs is not None:
        dev, test = (frame.filter(c).select("image_id") for c in ("partition = 'dev'", "partition = 'test'"))
        run.pairwise = train_ranking(features, restrict_pairs(pairs, dev), restrict_pairs(pairs, test))
    return run


def restrict_pairs(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Preferences whose two items are both in ids."""
    one = ids.select("image_id").distinct()
    for side in ("left_image_id", "right_image_id"):
        pairs = pairs.join(one.withColumnRenamed("image_id", side), side, "left_semi")
    return pairs


def pair_features(features: DataFrame, pairs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """left_image_id, right_image_id, left minus right of each feature, and y (1: the left one won); ties are left out."""
    columns = feature_columns(features)
    chosen = pairs if ids is None else restrict_pairs(pairs, ids)
    tie = F.coalesce(F.col("tie_flag"), F.lit(True)) if "tie_flag" in pairs.columns else F.lit(False)
    chosen = chosen.filter(~tie & F.col("winner").isNotNull()).select("left_image_id", "right_image_id", (F.col("winner") == F.col("left_image_id")).cast("int").alias("y"))
    sides = [features.select(F.col("image_id").alias(f"{s}_image_id"), *[F.col(c).cast("double").alias(f"_{s}_{c}") for c in columns]) for s in ("left", "right")]
    both = chosen.join(sides[0], "left_image_id").join(sides[1], "right_image_id")
    return both.select("left_image_id", "right_image_id", *[(F.col(f"_left_{c}") - F.col(f"_right_{c}")).alias(c) for c in columns], "y")


def train_ranking(features: DataFrame, train_pairs: DataFrame, eval_pairs: DataFrame) -> dict[str, object]:
    """A logistic preference model on feature differences: available, model, metrics; or why it is not."""
    columns = feature_columns(features)
    train, judged = cut(pair_features(features, train_pairs), "pairs"), pair_features(features, eval_pairs)
    seen = {r[0]: r[1] for r in train.groupBy("y").count().collect()}
    if len(seen) < 2:
        return {"available": False, "reason": "no preferences to learn from" if not seen else "all preferences have the same side"}
    scaler = Scaler.fit(train, columns)
    model = LogisticRegression(featuresCol="_x", labelCol="y", standardization=False, regParam=1 / sum(seen.values())).fit(scaler.assemble(train))
    scored = model.transform(scaler.assemble(judged)).select("y", vector_to_array("probability")[1].alias("score"))
    return {"available": True, "model": model, "scaler": scaler, "metrics": ranking_metrics(scored)}


def embed(features: DataFrame, k: int = 16, fit_on: DataFrame | None = None) -> DataFrame:
    """image_id, embed_00..: principal components of centred features (missing as 0), fitted on fit_on's items."""
    columns = feature_columns(features)
    filled = features.select("image_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    base = filled if fit_on is None else filled.join(fit_on.select("image_id").distinct(), "image_id", "left_semi")
    k = max(1, min(k, len(columns), base.limit(k).count()))
    means = base.agg(*[F.avg(c) for c in columns]).first()
    centre = lambda df: VectorAssembler(inputCols=columns, outputCol="_x").transform(df.withColumns({c: F.col(c) - float(m or 0) for c, m in zip(columns, means, strict=True)}))
    out = PCA(k=k, inputCol="_x", outputCol="_e").fit(centre(base)).transform(centre(filled))
    return out.withColumn("_a", vector_to_array("_e")).select("image_id", *[F.col("_a")[i].alias(f"embed_{i:02d}") for i in range(k)])


def hybrid_features(features: DataFrame, splits: DataFrame, k: int = 16) -> DataFrame:
    """features with their principal components, which are fitted on dev items only."""
    return features.join(embed(features, k, splits.filter("partition = 'dev'")), "image_id")


def train_hybrid(features: DataFrame, labels: DataFrame, splits: DataFrame, target: str = "mean_score", k: int = 16, holdout: int = 0, estimator: object | None = None) -> Run:
    """Boosted trees on features and their principal components; estimator overrides the trees' own settings."""
    return train_baseline(hybrid_features(features, splits, k), labels, splits, target=target, holdout=holdout, kinds=("gbt",), estimators={"gbt": estimator} if estimator else None)


def local_contributions(fitted: Fitted, features: DataFrame, reference: DataFrame, k: int | None = None) -> DataFrame:
    """image_id, feature, value, delta_prediction: a feature at the item's value, all others at their medians.

    Every item becomes one probe for each feature; the row of all medians is the same for all items and scored once.
    """
    columns = fitted.scaler.columns
    middle = quantiles(reference, columns, [0.5])
    rows = features.withColumns({f"_m_{c}": F.lit(middle[c][0]).cast("double") for c in columns})
    # as one text: a Column for each of the squared number of features takes the driver seconds
    double = lambda c: f"CAST(`{c.replace('`', '``')}` AS DOUBLE)"
    said = [(name, name.replace("\\", "\\\\").replace("'", "\\'")) for name in columns]
    cells = [", ".join([f"'feature', '{text}', 'value', {double(name)}", *[f"'{t}', {double(c if c == name else f'_m_{c}')}" for c, t in said]]) for name, text in said]
    probes = F.expr("array(" + ", ".join(f"named_struct({x})" for x in cells) + ")")
    scored = fitted.predict(rows.select("image_id", F.explode(probes).alias("x")).select("image_id", "x.*"))
    one = features.sparkSession.createDataFrame([tuple(middle[c][0] for c in columns)], ", ".join(f"`{c}` double" for c in columns))
    base = fitted.predict(one).first()["p"]
    out = scored.select("image_id", "feature", "value", (F.col("p") - F.lit(base)).alias("delta_prediction"))
    if k is None:
        return out
    from pyspark.sql import Window

    w = Window.partitionBy("image_id").orderBy(F.desc(F.abs("delta_prediction")), "feature")
    return out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def permutation_importance(fitted: Fitted, df: DataFrame, target: str, repeats: int = 8, seed: int = 42) -> DataFrame:
    """feature, importance_mean, importance_std: how much R2 falls when a feature's values are shuffled among rows.

    Rows are numbered once; in each repeat a keyed bijection of the numbers names the row that a row takes values from, so
    the shuffles are joins, not sorts.
    """
    columns = fitted.scaler.columns
    rows = cut(global_row_number(df.select("image_id", F.col(target).cast("double").alias("_y"), *columns), [F.col("image_id")], "_i"), "numbered")
    stats = regression_metrics(fitted.predict(rows), "_y", "p").first()
    n, base = rows.count(), stats["r2"]
    repeated = rows.withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    partner = (shuffled(F.col("_i") - 1, n, (F.col("_repeat") + seed).cast("long")) + 1).alias("_j")
    other = rows.select(F.col("_i").alias("_j"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    both = repeated.select("_y", *columns, "_repeat", partner).join(other, "_j")
    variants = F.array(*[F.struct(F.lit(name).alias("feature"), *[(F.col(f"_o_{c}") if c == name else F.col(c)).cast("double").alias(c) for c in columns]) for name in columns])
    scored = fitted.predict(both.select("_repeat", "_y", F.explode(variants).alias("x")).select("_repeat", "_y", "x.*"))
    got = scored.groupBy("feature", "_repeat").agg((1 - F.sum((F.col("_y") - F.col("p")) ** 2) / (F.var_pop("_y") * F.count(F.lit(1)))).alias("_r2"))
    return got.groupBy("feature").agg(F.avg(F.lit(base) - F.col("_r2")).alias("importance_mean"), F.stddev_pop(F.lit(base) - F.col("_r2")).alias("importance_std"))


def select_best(metrics: DataFrame) -> str:
    """The model with the least val MAE, by name among equals."""
    best = metrics.filter("role = 'val' AND mae IS NOT NULL").orderBy("mae", "model").first()
    if best is None:
        raise ValueError("no model has validation metrics")
    return best["model"]


def evaluate(features: DataFrame, labels: DataFrame, k: int = 2) -> dict[str, DataFrame]:
    """Group comparison, correlation and projection of a feature table."""
    from lumenrank.operators.analysis import compare_groups, correlation, quantile_selectors

    high, mid = quantile_selectors(features.join(labels.select("image_id", "mean_score"), "image_id"))
    return {"groups": compare_groups(features, labels.select("image_id", "mean_score"), high, mid), "correlation": correlation(features), "projection": embed(features, k)}


def write_evaluation(tables: dict[str, DataFrame], root: str, run_id: str) -> dict[str, str]:
    """Write the tables of an evaluation beside a run, in its folder; returns where each lies."""
    paths = {name: f"{root.rstrip('/')}/{run_id}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(paths[name])
    return paths
