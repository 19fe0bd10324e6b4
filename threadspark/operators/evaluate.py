"""Recall and false-positive rate of the detector over labelled threads."""

from pyspark.sql import DataFrame, functions as F

REVIEWABLE_SCORE = 40
MIN_CASES = 30
MIN_RECALL = 0.8


def evaluate_corpus(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of metrics.  ``cases`` holds ``thread_id, label``; ``findings`` holds ``thread_id, score``.

    The percentile is by nearest rank over the number of findings per case.
    """
    per_case = findings.groupBy("thread_id").agg(
        (F.max("score") >= REVIEWABLE_SCORE).alias("flagged"), F.count("*").alias("finding_count")
    )
    rows = cases.join(per_case, "thread_id", "left").withColumns(
        {"flagged": F.coalesce("flagged", F.lit(False)), "finding_count": F.coalesce("finding_count", F.lit(0))}
    )
    severe, normal = F.col("label") == "severe_conflict", F.col("label") == "normal_discussion"
    totals = rows.agg(
        F.count("*").alias("cases"), F.count_if(severe).alias("severe_total"), F.count_if(severe & F.col("flagged")).alias("severe_found"),
        F.count_if(normal).alias("normal_total"), F.count_if(normal & F.col("flagged")).alias("normal_flagged"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY finding_count)").cast("bigint").alias("p95_findings"),
    )

    def rate(part, whole):
        return F.round(F.when(F.col(whole) == 0, 0.0).otherwise(F.col(part) / F.col(whole)), 4)

    recall = F.when(F.col("severe_total") == 0, 0.0).otherwise(F.col("severe_found") / F.col("severe_total"))
    return totals.withColumns(
        {
            "severe_recall": rate("severe_found", "severe_total"),
            "normal_false_positive_rate": rate("normal_flagged", "normal_total"),
            "passed": (F.col("cases") >= MIN_CASES) & (F.col("severe_total") > 0) & (recall >= MIN_RECALL),
        }
    )
