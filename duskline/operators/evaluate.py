"""Model evaluation and drift: one conditional aggregate, or cumulative sums over distinct scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskline.operators.aggregates import exact_quantiles, join_groups, quantile_higher, running_total, running_totals


def binary_metrics(df: DataFrame, y: str, p: str, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Confusion counts, accuracy, balanced accuracy, precision, recall, F1, Brier score, log loss, prevalence."""
    hit, real = F.col(p) >= threshold, F.col(y) == 1
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-15)), F.lit(1e-15))
    c = df.groupBy(*(by or [])).agg(
        F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & ~real).alias("tn"), F.count_if(~hit & real).alias("fn"),
        F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"), F.avg(-F.when(real, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"))
    out = c.selectExpr("*", "(tp + tn) / (tp + fp + tn + fn) as accuracy", "try_divide(tp, tp + fp) as precision", "try_divide(tp, tp + fn) as recall", "try_divide(tn, tn + fp) as specificity", "(tp + fn) / (tp + fp + tn + fn) as prevalence")
    return out.selectExpr("*", "(recall + specificity) / 2 as balanced_accuracy", "try_divide(2 * precision * recall, precision + recall) as f1")


def _curve(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """Positives and negatives at or above each distinct score, by running totals over ranges of scores."""
    n = df.groupBy(*by, F.col(p).alias("_p")).agg(F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) != 1).alias("_neg"))
    ran = running_totals(n, "_p", {"_cp": "_pos", "_cn": "_neg"}, by)
    size = n.groupBy(*by).agg(F.sum("_pos").alias("pos"), F.sum("_neg").alias("neg"))
    j = join_groups(ran, size, by)
    return j.select(*by, "_p", "_pos", "_neg", (F.col("pos") - F.col("_cp") + F.col("_pos")).alias("tp"), (F.col("neg") - F.col("_cn") + F.col("_neg")).alias("fp"), "pos", "neg")


def ranking_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """ROC AUC (ties count half), average precision, and the threshold of largest TPR - FPR (ties: the highest), by group."""
    by = by or []
    c = _curve(df, y, p, by)
    auc = F.sum((F.col("tp") - F.col("_pos") / 2) * F.col("_neg")) / (F.first("pos") * F.first("neg"))
    ap = F.sum(F.col("_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.first("pos")
    youden = F.max(F.struct(F.round(F.col("tp") / F.col("pos") - F.col("fp") / F.col("neg"), 12).alias("j"), F.col("_p").alias("p")))
    return c.where("pos > 0 and neg > 0").groupBy(*by).agg(auc.alias("auc"), ap.alias("average_precision"), youden.getField("p").alias("youden_threshold"))


def calibration_table(df: DataFrame, y: str, p: str, key: str, bins: int = 10) -> DataFrame:
    """Equal-size bins by rank of the score (ties by key): rows, mean score, observed share, absolute gap."""
    counts = df.groupBy(F.col(p).alias("_v")).agg(F.count("*").alias("_c"))
    before = running_total(counts, "_v", "_c", "_cum").select("_v", (F.col("_cum") - F.col("_c")).alias("_before"))
    at = F.col("_before") + F.row_number().over(Window.partitionBy(p).orderBy(key)) - 1  # place by score, then key
    rows = df.agg(F.count("*").alias("_n"))
    n = df.join(before, F.col(p) == F.col("_v")).crossJoin(F.broadcast(rows)).withColumn("_at", at)
    n = n.withColumn("_big", F.expr(f"_n % {bins} * (_n div {bins} + 1)"))  # rows in the bins that hold one more
    n = n.withColumn("bin", F.expr(f"cast(case when _at < _big then _at div (_n div {bins} + 1) else _n % {bins} + (_at - _big) div greatest(_n div {bins}, 1) end + 1 as int)"))
    return n.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed")).withColumn("gap", F.abs(F.col("predicted") - F.col("observed")))


def psi_numeric(reference: DataFrame, new: DataFrame, col: str, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability index on the reference's quantile bins; shares are floored."""
    edges = exact_quantiles(reference, col, [i / bins for i in range(1, bins)]).withColumnRenamed("q", "_e")
    binned = lambda df: df.where(F.col(col).isNotNull()).crossJoin(F.broadcast(edges)).select(F.size(F.filter("_e", lambda e: e < F.col(col))).alias("b").cast("string"))
    return _psi(binned(reference), binned(new), floor)


def psi_categorical(reference: DataFrame, new: DataFrame, col: str, floor: float = 1e-4) -> DataFrame:
    """Population stability index over the categories of either side."""
    return _psi(reference.select(F.col(col).alias("b")), new.select(F.col(col).alias("b")), floor)


def _psi(a: DataFrame, b: DataFrame, floor: float) -> DataFrame:
    both = a.withColumn("s", F.lit(0)).unionByName(b.withColumn("s", F.lit(1)))
    n = both.groupBy("b").agg(F.count_if(F.col("s") == 0).alias("na"), F.count_if(F.col("s") == 1).alias("nb"))
    total = n.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    p, q = F.greatest(F.col("na") / F.col("ta"), F.lit(floor)), F.greatest(F.col("nb") / F.col("tb"), F.lit(floor))
    return n.crossJoin(total).agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def rate_metrics(df: DataFrame, y: str, mu: str) -> DataFrame:
    """Poisson deviance, mean absolute and root mean squared error, against a constant prediction."""
    m = df.agg(F.avg(y).alias("_m"))
    dev = lambda pred: 2 * (F.when(F.col(y) > 0, F.col(y) * F.log(F.col(y) / pred)).otherwise(0.0) - (F.col(y) - pred))
    return df.crossJoin(F.broadcast(m)).agg(
        F.avg(dev(F.col(mu))).alias("deviance"), F.avg(dev(F.col("_m"))).alias("constant_deviance"), F.avg(F.abs(F.col(y) - F.col(mu))).alias("mae"), F.sqrt(F.avg((F.col(y) - F.col(mu)) ** 2)).alias("rmse"))


def metrics_by_group(df: DataFrame, y: str, p: str, by: list[str], threshold: float = 0.5, least: int = 10) -> DataFrame:
    """All binary and ranking metrics of each group with at least ``least`` rows and both outcomes."""
    size = df.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(y).alias("_k")).where((F.col("n") >= least) & (F.col("_k") == 2)).drop("_k")
    rank = join_groups(binary_metrics(df, y, p, threshold, by), ranking_metrics(df, y, p, by), by)
    return join_groups(rank, size, by)


def weighted_group_auc(df: DataFrame, y: str, p: str, by: list[str], least: int = 10) -> DataFrame:
    """The mean of the groups' AUC weighted by their rows, and how many groups it is of: ranking within groups only."""
    g = metrics_by_group(df, y, p, by, least=least)
    return g.agg((F.sum(F.col("auc") * F.col("n")) / F.sum("n")).alias("auc_within"), F.count("*").alias("groups"))


def drift_table(reference: DataFrame, new: DataFrame, numeric: list[str], categorical: list[str], limit: float = 0.2) -> DataFrame:
    """One row a column: its stability index, the missing rates of both sides, and ``drifted`` (index above ``limit``)."""
    rows = []
    for c in [*numeric, *categorical]:
        psi = psi_numeric(reference, new, c) if c in numeric else psi_categorical(reference, new, c)
        gone = lambda df, name: df.agg(F.avg(F.col(c).isNull().cast("double")).alias(name))  # noqa: B023, E731
        rows.append(psi.crossJoin(gone(reference, "missing_reference")).crossJoin(gone(new, "missing_new")).select(F.lit(c).alias("column_name"), "psi", "missing_reference", "missing_new", (F.col("psi") > limit).alias("drifted")))
    return reduce(DataFrame.unionByName, rows)


def top_share(df: DataFrame, y: str, mu: str, share: float = 0.1) -> DataFrame:
    """``capture``: the part of all outcomes in the rows predicted at or above the 1 - ``share`` quantile, ``lift``: that over
    these rows' part of all."""
    cut_off = quantile_higher(df, mu, 1 - share)
    top = F.col(mu) >= F.col("q_value")
    r = df.crossJoin(F.broadcast(cut_off)).agg((F.sum(F.when(top, F.col(y)).otherwise(0)) / F.sum(y)).alias("capture"), F.avg(top.cast("double")).alias("_part"))
    return r.select("capture", (F.col("capture") / F.col("_part")).alias("lift"))


def tracking_table(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """Predicted and observed mean of each group, their difference, and rows."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"))
    return g.withColumn("difference", F.col("predicted") - F.col("observed"))
