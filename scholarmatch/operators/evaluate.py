"""Precision, agreement, gates and comparison with an earlier snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def disambiguation_scores(predictions: DataFrame, gold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1; ``match`` and ``review`` count as the person.

    ``predictions``: item_id, belongs; ``gold``: item_id, expected and the ``by`` columns.
    """
    real = F.col("expected").isin("match", "review")
    rows = gold.join(predictions, "item_id").select(*by, F.col("belongs").alias("p"), real.alias("r"))
    sums = rows.groupBy(*by).agg(
        F.count_if(F.col("p") & F.col("r")).alias("tp"),
        F.count_if(F.col("p") & ~F.col("r")).alias("fp"),
        F.count_if(~F.col("p") & F.col("r")).alias("fn"),
        F.count_if(~F.col("p") & ~F.col("r")).alias("tn"),
    )
    scored = sums.withColumns(
        {
            "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    )
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), both))


def disambiguation_metrics(scores: DataFrame) -> DataFrame:
    """The one-row scores as metric rows; only recall has a gate."""
    return scores.selectExpr(
        "stack(3, 'disambig.precision', precision, true, CAST(NULL AS DOUBLE),"
        " 'disambig.recall', recall, true, CAST(0.9 AS DOUBLE),"
        " 'disambig.f1', f1, true, CAST(NULL AS DOUBLE)) AS (key, value, higher_is_better, gate)"
    )


def claim_scores(claims: DataFrame, errors: DataFrame, gold: DataFrame) -> DataFrame:
    """Metric rows: agreement of the claim check with the gold labels, and how many were to be refused."""
    failed = errors.select("claim_id").distinct().withColumn("_bad", F.lit(True))
    rows = claims.select("claim_id").join(gold, "claim_id").join(failed, "claim_id", "left")
    valid = F.col("_bad").isNull()
    sums = rows.agg(
        F.coalesce(F.avg(F.when(valid == F.col("expected_valid"), 1.0).otherwise(0.0)), F.lit(0.0)).alias("accuracy"),
        F.count_if(~F.col("expected_valid")).cast("double").alias("refused"),
    )
    return sums.selectExpr(
        "stack(2, 'claims.accuracy', accuracy, true, CAST(1.0 AS DOUBLE),"
        " 'claims.unsupported_detected', refused, true, CAST(NULL AS DOUBLE)) AS (key, value, higher_is_better, gate)"
    )


def metric_gates(metrics: DataFrame) -> DataFrame:
    """Metrics with ``passed``; a metric without a gate passes."""
    met = F.when(F.col("higher_is_better"), F.col("value") >= F.col("gate")).otherwise(F.col("value") <= F.col("gate"))
    return metrics.withColumn("passed", F.col("gate").isNull() | met)


def gates_passed(gated: DataFrame) -> DataFrame:
    return gated.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("gates_passed"))


def save_baseline(metrics: DataFrame, path: str) -> None:
    metrics.select("key", "value").write.mode("overwrite").json(path)


def load_baseline(spark, path: str) -> DataFrame:
    return spark.read.schema("key string, value double").json(path)


def compare_to_baseline(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """(key, before, after, delta, regressed, new) of every metric."""
    old = baseline.select("key", F.col("value").alias("before"))
    rows = metrics.join(old, "key", "left").withColumn("delta", F.col("value") - F.col("before"))
    worse = F.when(F.col("higher_is_better"), F.col("delta") < 0).otherwise(F.col("delta") > 0)
    return rows.select(
        "key",
        "before",
        F.col("value").alias("after"),
        "delta",
        F.coalesce((F.abs("delta") >= 1e-9) & worse, F.lit(False)).alias("regressed"),
        F.col("before").isNull().alias("new"),
    )
