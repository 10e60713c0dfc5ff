"""Entity-level and pair-level quality of predicted links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f05(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """F0.5 of one entity: 1 if nothing is true and nothing predicted, 0 if one side only is empty."""
    p, r = tp / n_pred, tp / n_true
    return F.when((n_true == 0) & (n_pred == 0), 1.0).when((n_true == 0) | (n_pred == 0) | (tp == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def entity_counts(entities: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """s1_id, n_true, n_pred, tp for every entity, also those without links."""
    marks = truth.select("s1_id", "cand_id", F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(predicted.select("s1_id", "cand_id", F.lit(0).alias("t"), F.lit(1).alias("p")))
    pairs = marks.groupBy("s1_id", "cand_id").agg(F.max("t").alias("t"), F.max("p").alias("p"))
    counts = pairs.groupBy("s1_id").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum(F.col("t") * F.col("p")).alias("tp"))
    return entities.select("s1_id").join(counts, "s1_id", "left").fillna(0)


def entity_metrics(counts: DataFrame) -> DataFrame:
    tp, n_pred, n_true = F.col("tp"), F.col("n_pred"), F.col("n_true")
    empty = (n_true == 0) & (n_pred == 0)
    return counts.withColumns({
        "f05": f05(tp, n_pred, n_true), "precision": F.when(empty, 1.0).when((n_pred == 0) | (n_true == 0), 0.0).otherwise(tp / n_pred),
        "recall": F.when(empty, 1.0).when((n_pred == 0) | (n_true == 0), 0.0).otherwise(tp / n_true), "fp": n_pred - tp, "fn": n_true - tp,
    })


def _share(top: Column, bottom: Column) -> Column:
    return F.round(F.when(bottom > 0, top / bottom).otherwise(0.0), 6)


def evaluate(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The whole evaluation as one row, or one for each group."""
    m = entity_metrics(counts)
    single, pred = F.col("n_true") == 0, F.col("n_pred") > 0
    n = lambda c: F.sum(c.cast("long"))
    bins = {"bin_0": F.col("f05") == 0, "bin_low": (F.col("f05") > 0) & (F.col("f05") < 0.5), "bin_mid": (F.col("f05") >= 0.5) & (F.col("f05") < 0.8),
            "bin_high": (F.col("f05") >= 0.8) & (F.col("f05") < 1), "bin_1": F.col("f05") == 1}
    out = m.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("entities"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("n_pred").alias("predicted"), F.sum("n_true").alias("true_links"),
        n(single).alias("singletons"), n(single & ~pred).alias("singletons_correct"), n(single & pred).alias("singletons_merged"), n(pred).alias("with_predictions"),
        F.max("n_pred").alias("max_predictions"), F.round(F.avg("f05"), 6).alias("macro_f05"), F.round(F.coalesce(F.avg(F.when(pred, F.col("precision"))), F.lit(0.0)), 6).alias("macro_precision"),
        F.round(F.coalesce(F.avg(F.when(~single, F.col("recall"))), F.lit(0.0)), 6).alias("macro_recall"), *[n(c).alias(k) for k, c in bins.items()],
    )
    p, r = F.col("tp") / F.col("predicted"), F.col("tp") / F.col("true_links")
    return out.withColumns({
        "pooled_precision": _share(F.col("tp"), F.col("predicted")), "pooled_recall": _share(F.col("tp"), F.col("true_links")),
        "pooled_f05": F.round(F.when(F.col("tp") > 0, 1.25 * p * r / (0.25 * p + r)).otherwise(0.0), 6), "singleton_accuracy": _share(F.col("singletons_correct"), F.col("singletons")),
    })
