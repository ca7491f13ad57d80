"""Leakage-safe features, candidate classifiers, and what they rely on."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskline.operators.evaluate import ranking_metrics
from duskline.operators.windows import trailing_counts
from duskline.session import cut


def engineer_features(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Calendar features and counts of strictly earlier rows of the same key; nothing looks ahead of the row's time."""
    df = trailing_counts(df, key, ts, {"prior_7d": 7, "prior_1d": 1}, "since_previous_s")
    return df.withColumn("hour", F.hour(ts)).withColumn("dow", F.weekday(ts)).withColumn("weekend", (F.weekday(ts) >= 5).cast("int")).withColumn("business", (F.hour(ts).between(9, 17) & (F.weekday(ts) < 5)).cast("int"))


def fold_rare(df: DataFrame, col: str, least: int) -> DataFrame:
    """Values seen fewer than ``least`` times become ``other``; null stays null."""
    common = df.groupBy(col).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(F.col(col).alias("_k"))
    return df.join(common, F.col(col) == F.col("_k"), "left").withColumn(col, F.when(F.col(col).isNotNull(), F.coalesce("_k", F.lit("other")))).drop("_k")


def preprocessing(numeric: list[str], categorical: list[str], logged: tuple[str, ...] = ()) -> list:
    """Median imputation, log1p of the columns in ``logged`` (negative values count as 0), scaling and one-hot stages that end
    in ``features``. Add missing flags with ``missing_flags`` first."""
    filled = [f"{c}_filled" for c in numeric]
    logs = [SQLTransformer(statement="SELECT *, " + ", ".join(f"ln(1 + greatest({c}_filled, 0)) AS {c}_log" for c in logged) + " FROM __THIS__")] if logged else []
    used = [f"{c}_log" if c in logged else f"{c}_filled" for c in numeric]
    return [
        Imputer(inputCols=numeric, outputCols=filled, strategy="median"),
        *logs,
        StringIndexer(inputCols=categorical, outputCols=[f"{c}_index" for c in categorical], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{c}_index" for c in categorical], outputCols=[f"{c}_hot" for c in categorical]),
        VectorAssembler(inputCols=[*used, *[f"{c}_hot" for c in categorical]], outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features"),
    ]


def missing_flags(df: DataFrame, numeric: list[str]) -> DataFrame:
    return df.select("*", *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in numeric])


def candidates(label: str = "label", seed: int = 1, weight: str | None = None) -> dict:
    """Classifiers to choose from: logistic regressions of three strengths, four forests, four boosted ensembles. ``weight``
    names a column of row weights, such as ``class_weights`` gives."""
    more = {"labelCol": label} | ({"weightCol": weight} if weight else {})
    out: dict = {f"logistic_{name}": LogisticRegression(regParam=reg, **more) for name, reg in (("strong", 0.1), ("middle", 0.01), ("weak", 0.001))}
    for depth in (4, 8):
        out |= {f"forest_{depth}_{leaf}": RandomForestClassifier(numTrees=20, maxDepth=depth, minInstancesPerNode=leaf, seed=seed, **more) for leaf in (5, 30)}
        out |= {f"boosted_{depth // 2}_{rate}": GBTClassifier(maxIter=8, maxDepth=depth // 2, stepSize=rate, seed=seed, **more) for rate in (0.1, 0.3)}
    return out


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """``out``: rows of the other outcome per row of the own one, halved, so that both outcomes weigh alike in sum."""
    n = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_t"))
    return df.join(n.crossJoin(F.broadcast(total)), F.col(label) == F.col("_l")).withColumn(out, F.col("_t") / (2 * F.col("_n"))).drop("_l", "_n", "_t")


def with_probability(model: Model, df: DataFrame, out: str = "p") -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("probability")[1])


def fit_candidates(train: DataFrame, validation: DataFrame, stages: list, models: dict, label: str = "label") -> tuple[dict, DataFrame]:
    """All fitted pipelines, and a table of their validation AUC with the best one marked (ties: by name).

    ``stages`` are fitted once and only what the models read is kept of their rows. The scores of all models are ranked together.
    """
    train = cut(train)
    prepared = Pipeline(stages=stages).fit(train)
    read = list(dict.fromkeys(m.getOrDefault(p) for m in models.values() for p in ("featuresCol", "labelCol", "weightCol") if m.hasParam(p) and m.isDefined(p)))
    rows = cut(prepared.transform(train).select(*read))
    fitted = {name: PipelineModel([*prepared.stages, model.fit(rows)]) for name, model in models.items()}
    seen = cut(prepared.transform(validation).select(label, *[c for c in read if c in {m.getOrDefault("featuresCol") for m in models.values()} - {label}]))
    scored = reduce(DataFrame.unionByName, [with_probability(f.stages[-1], seen).select(F.lit(name).alias("model"), label, "p") for name, f in fitted.items()])
    auc = {r.model: r.auc for r in ranking_metrics(scored, label, "p", ["model"]).select("model", "auc").collect()}
    best = min(models, key=lambda n: (-(auc.get(n) or 0), n))
    return fitted, train.sparkSession.createDataFrame([(n, auc.get(n), n == best) for n in models], "model string, auc double, chosen boolean")


def permuted(df: DataFrame, col: str, key: str, seed: int) -> DataFrame:
    """``df`` with the values of ``col`` dealt anew: in each of many hash groups of rows the values move on by one place in a
    seeded order, so a large table is never ordered as a whole."""
    group = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(64))
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.col(key), F.lit(seed + 1)), key)
    return df.withColumn(col, F.coalesce(F.lag(col).over(w), F.last(col).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))


def permutation_importance(model: PipelineModel, df: DataFrame, cols: list[str], key: str, label: str = "label", repeats: int = 2) -> DataFrame:
    """Mean loss of AUC when a column is permuted."""
    auc = lambda d: ranking_metrics(with_probability(model, d), label, "p").first().auc
    df = cut(df)
    base = auc(df)
    rows = [(c, sum(base - auc(permuted(df, c, key, 10 * i)) for i in range(repeats)) / repeats) for c in cols]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def group_kfold_predict(df: DataFrame, group: str, y: str, exposure: str, features: list[str], folds: int = 3) -> DataFrame:
    """Out-of-fold Poisson rates: each group's rows are predicted by a model that saw no row of the group."""
    fold = F.pmod(F.xxhash64(group), F.lit(folds)).cast("int")
    df = cut(df.withColumn("_fold", fold).withColumn("_rate", F.col(y) / F.col(exposure)))
    stage = VectorAssembler(inputCols=features, outputCol="_x")
    glr = GeneralizedLinearRegression(family="poisson", link="log", labelCol="_rate", featuresCol="_x", weightCol=exposure, predictionCol="predicted_rate", regParam=0.01)
    out = None
    for k in range(folds):
        model = Pipeline(stages=[stage, glr]).fit(df.where(F.col("_fold") != k))
        part = model.transform(df.where(F.col("_fold") == k)).drop("_x")
        out = part if out is None else out.unionByName(part)
    return out.drop("_fold", "_rate")
