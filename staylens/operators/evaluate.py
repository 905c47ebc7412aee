"""Evaluation of class predictions, from one small table of pair counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.functions.scalars import column
from staylens.operators.checks import require_columns


def accuracy(df: DataFrame, label: str, predicted: str, copies: str | None = None) -> DataFrame:
    """One row (accuracy): the share of equal labels; ``copies`` says how many rows a row stands for."""
    require_columns(df, [label, predicted, *([copies] if copies else [])])
    same = F.coalesce((column(label) == column(predicted)).cast("double"), F.lit(0.0))
    if copies is None:
        return df.agg(F.avg(same).alias("accuracy"))
    return df.agg(F.try_divide(F.sum(same * column(copies)), F.sum(column(copies))).alias("accuracy"))


def _pairs(df: DataFrame, label: str, predicted: str) -> DataFrame:
    require_columns(df, [label, predicted])
    return df.where(column(label).isNotNull() & column(predicted).isNotNull()).groupBy(
        column(label).alias("label"), column(predicted).alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(label, predicted, n) for every pair of classes, zero cells included."""
    pairs = _pairs(df, label, predicted)
    # the classes come from the counted pairs: a handful of rows
    classes = pairs.select(F.explode(F.array("label", "predicted")).alias("c")).agg(
        F.array_sort(F.collect_set("c")).alias("classes")
    )
    cells = classes.select("classes", F.explode("classes").alias("label")).select(
        "label", F.explode("classes").alias("predicted")
    )
    return cells.join(pairs, ["label", "predicted"], "left").select(
        "label", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(class, precision, recall, f1, support) per class, then accuracy and averages.

    An empty denominator gives 0. The accuracy row holds its value in ``f1``.
    """
    pairs = _pairs(df, label, predicted)
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    both = F.array(
        F.struct(F.col("label").cast("string").alias("class"), hit.alias("hits"), F.col("n").alias("support"), zero.alias("claims")),
        F.struct(F.col("predicted").cast("string").alias("class"), zero.alias("hits"), zero.alias("support"), F.col("n").alias("claims")),
    )
    sums = pairs.select(F.inline(both)).groupBy("class").agg(
        F.sum("hits").alias("hits"), F.sum("support").alias("support"), F.sum("claims").alias("claims")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per_class = sums.select(
        "class", "hits", "support",
        ratio(F.col("hits"), F.col("claims")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
    ).withColumn(
        "f1",
        ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )
    total = F.sum("support")
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / total).alias(f"w_{c}")
    whole = per_class.agg(
        total.alias("total"), (F.sum("hits") / total).alias("accuracy"),
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c) for c in ("precision", "recall", "f1")],
    )
    line = lambda name, p, r, f: F.struct(
        F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
        F.col("total").alias("support"),
    )
    nothing = F.lit(None).cast("double")
    summary = whole.select(
        F.inline(
            F.array(
                line("accuracy", nothing, nothing, F.col("accuracy")),
                line("macro avg", F.col("m_precision"), F.col("m_recall"), F.col("m_f1")),
                line("weighted avg", F.col("w_precision"), F.col("w_recall"), F.col("w_f1")),
            )
        )
    )
    return per_class.select("class", "precision", "recall", "f1", "support").unionByName(summary)
