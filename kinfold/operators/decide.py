"""From scored pairs to links, and the calibration of the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .metrics import f05


def by_threshold(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.where(F.col("score") >= threshold)


def by_null_margin(scored: DataFrame, tau: float, tau_null: float, delta: float) -> DataFrame:
    """An entity whose best score is below tau_null gets no link; else scores of at least tau within delta of the best."""
    top = scored.withColumn("top", F.max("score").over(Window.partitionBy("s1_id")))
    return top.where((F.col("top") >= tau_null) & (F.col("score") >= tau) & (F.col("score") >= F.col("top") - delta)).drop("top")


def grid(spark: SparkSession) -> DataFrame:
    """The configurations that calibration tries, numbered in order."""
    # Thresholds, what they may add for the best score, and margins.
    rows = [
        (tau / 100, (tau + null) / 100, delta)
        for tau in range(45, 100, 5) for null in (0, 5, 10, 15, 20) for delta in (0.0, 0.03, 0.05, 0.10, 0.15, 0.20, 1.0) if tau + null <= 100
    ]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "cfg int, tau double, tau_null double, delta double")


def calibrate(scored: DataFrame, entities: DataFrame, truth: DataFrame) -> DataFrame:
    """Macro F0.5 of every configuration, best first; the grid has 300 to 400 rows and goes to every task.

    Scores meet the grid by entity: an entity's pairs are aggregated for each configuration before anything is shuffled.
    """
    spark = scored.sparkSession
    n_true = truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
    marked = scored.join(truth.withColumn("t", F.lit(1)), ["s1_id", "cand_id"], "left").withColumn("top", F.max("score").over(Window.partitionBy("s1_id")))
    tried = marked.join(F.broadcast(grid(spark)), (F.col("top") >= F.col("tau_null")) & (F.col("score") >= F.col("tau")) & (F.col("score") >= F.col("top") - F.col("delta")))
    counts = tried.groupBy("cfg", "s1_id").agg(F.count(F.lit(1)).alias("n_pred"), F.sum(F.coalesce("t", F.lit(0))).alias("tp")).join(n_true, "s1_id", "left").fillna(0, ["n_true"])
    predicted = counts.groupBy("cfg").agg(
        F.sum(f05(F.col("tp"), F.col("n_pred"), F.col("n_true"))).alias("sum_f05"), F.sum((F.col("n_true") == 0).cast("long")).alias("merged"), F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred")
    )
    # Entities without a prediction score 1 if they have no true link either.
    total = entities.select("s1_id").join(n_true, "s1_id", "left").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_true").isNull().cast("long")).alias("single"))
    return (
        grid(spark).join(predicted, "cfg", "left").fillna(0).join(F.broadcast(total))
        .select("cfg", "tau", "tau_null", "delta", F.round((F.col("sum_f05") + F.col("single") - F.col("merged")) / F.col("n"), 6).alias("macro_f05"), "tp", "n_pred")
        .orderBy(F.desc("macro_f05"), "cfg")
    )
