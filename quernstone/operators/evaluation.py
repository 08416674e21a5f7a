"""Classification quality: confusion, metrics, panels, paired tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def error_type(gold: Column, pred: Column) -> Column:
    return F.when(~gold.isin("y", "n") | gold.isNull(), "unknown").when(gold == "y", F.when(pred == "y", "tp").otherwise("fn")).otherwise(F.when(pred == "y", "fp").otherwise("tn"))


def confusion(df: DataFrame, gold: Column, pred: Column, groups: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy; an undecided prediction is negative, empty ratios are 0."""
    kind = error_type(gold, pred)
    counted = df.groupBy(*(groups or [])).agg(*[F.count_if(kind == k).alias(k) for k in ("tp", "fp", "fn", "tn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    out = counted.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))).withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))


def paired(df: DataFrame, gold: Column, old: Column, new: Column) -> DataFrame:
    """b (old right, new wrong), c (the reverse), n, the exact two-sided McNemar p, and its decimal logarithm."""
    ok = gold.isin("y", "n") & old.isin("y", "n") & new.isin("y", "n")
    counts = df.where(ok).agg(F.count_if((old == gold) & (new != gold)).alias("b"), F.count_if((old != gold) & (new == gold)).alias("c"), F.count(F.lit(1)).alias("n"))

    @F.pandas_udf("double")
    def exact(b: pd.Series, c: pd.Series) -> pd.Series:
        def p(x: int, y: int) -> float:
            n, k = x + y, min(x, y)
            # in logarithms, so any n works
            each = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
            return min(1.0, 2 * math.fsum(math.exp(e) for e in each))

        return pd.Series([p(int(x), int(y)) for x, y in zip(b, c)])

    return counts.withColumn("p_value", exact("b", "c")).withColumn("log10_p", F.log10("p_value"))


def pair(old: DataFrame, new: DataFrame, label: str = "label") -> DataFrame:
    """(post_id, gold, old, new): two runs' predictions of the same posts side by side."""
    return old.select("post_id", "gold", F.col(label).alias("old")).join(new.select("post_id", F.col(label).alias("new")), "post_id")


def label_shift(df: DataFrame, old: Column, new: Column) -> DataFrame:
    """Chi-square of the labels of two predictors: chi2, dof, p and whether it is under 0.05.

    p is exp(-x/2) for two degrees of freedom, which three labels give, erfc(sqrt(x/2)) for one, and 1 for none.
    """
    labels = df.select(F.explode(F.array(F.struct(F.lit("old").alias("version"), old.alias("label")), F.struct(F.lit("new").alias("version"), new.alias("label")))).alias("x")).select("x.*").where("label IS NOT NULL")
    cells = labels.groupBy("label").agg(F.count_if(F.col("version") == "old").alias("o"), F.count_if(F.col("version") == "new").alias("n"))
    sums = cells.agg(F.sum("o").alias("so"), F.sum("n").alias("sn"), F.count(F.lit(1)).alias("k"))
    joined = cells.crossJoin(F.broadcast(sums))  # a label each, against one row
    eo, en = (F.col("o") + F.col("n")) * F.col("so") / (F.col("so") + F.col("sn")), (F.col("o") + F.col("n")) * F.col("sn") / (F.col("so") + F.col("sn"))
    part = F.pow(F.col("o") - eo, 2) / eo + F.pow(F.col("n") - en, 2) / en
    found = joined.agg(F.sum(part).alias("chi2"), (F.max("k") - 1).alias("dof"))

    @F.pandas_udf("double")
    def one_degree(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(v / 2)))

    p = F.when(F.col("dof") == 2, F.exp(-F.col("chi2") / 2)).when(F.col("dof") == 1, one_degree("chi2")).when(F.col("dof") == 0, F.lit(1.0))
    return found.withColumn("p_value", p).withColumn("shifted", F.col("p_value") < 0.05)


def gate(b: Column, c: Column, p_value: Column, f1_old: Column, f1_new: Column, alpha: float = 0.05) -> Column:
    """Why a new predictor is kept or not."""
    return F.when(f1_new < f1_old, "reject_f1_regression").when((p_value < alpha) & (c > b), "accept_improvement").otherwise("reject_no_improvement")
