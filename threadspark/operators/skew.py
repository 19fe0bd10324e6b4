"""Joins whose key may hold a third of all rows.

Heavy keys are found by a mergeable frequent-items sketch: each task keeps a bounded summary of hashed keys, summaries are
merged in two steps, and at most ``HEAVY`` keys come out, so their table may always be broadcast.  Rows of a heavy key are
dealt over copies of the other side's rows, as many as its share asks for; all other rows are joined plainly.
"""

from pyspark.sql import Column, DataFrame, functions as F

#: A key is heavy from this share of the rows on (one in HEAVY); so there are at most as many.
HEAVY = 200
# Items of a summary: the error of a count is below a third of the heavy share.
_ITEMS, _FOLDS = 4_096, 64
_KEY, _COPIES, _SALT = "_skew_key", "_skew_copies", "_skew_salt"


def heavy_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Hash of each heavy key and the number of copies it asks for; at most ``HEAVY`` rows."""
    hashed = rows.select(F.xxhash64(*keys).alias("key"))
    folded = hashed.groupBy(F.pmod(F.spark_partition_id(), F.lit(_FOLDS)).alias("fold")).agg(
        F.expr(f"approx_top_k_accumulate(key, {_ITEMS})").alias("summary"), F.count("*").alias("n")
    )
    whole = folded.groupBy(F.lit("all")).agg(  # grouped, as the summary of no rows cannot be read
        F.expr(f"approx_top_k_combine(summary, {_ITEMS})").alias("summary"), F.sum("n").alias("n")
    )
    top = whole.select("n", F.explode(F.expr(f"approx_top_k_estimate(summary, {HEAVY})")).alias("top"))
    share = F.col("top.count") * HEAVY / F.col("n")
    return top.filter(share > 1).select(F.col("top.item").alias(_KEY), F.ceil(share).cast("int").alias(_COPIES))


def _marked(rows: DataFrame, on: list[str], heavy: DataFrame) -> DataFrame:
    return rows.withColumn(_KEY, F.xxhash64(*on)).join(heavy, _KEY, "left")


def skew_join(
    big: DataFrame, small: DataFrame, on: list[str], spread: list[str | Column], how: str = "inner", heavy: DataFrame | None = None
) -> DataFrame:
    """``big`` joined with ``small`` (``inner``, ``left``, ``left_semi`` or ``left_anti``) on equal columns ``on``.

    ``spread``: columns of ``big`` that tell its rows of one key apart.  ``small`` should have few rows per key: those of
    a heavy key are copied.  ``heavy``: the heavy keys of ``big``, if they are known from an earlier join.
    """
    heavy = F.broadcast(heavy_keys(big, on) if heavy is None else heavy)
    salt = F.when(F.col(_COPIES).isNotNull(), F.pmod(F.xxhash64(*spread), F.col(_COPIES))).otherwise(F.lit(0))
    left = _marked(big, on, heavy).withColumn(_SALT, salt.cast("int")).drop(_KEY, _COPIES)
    copies = F.sequence(F.lit(0), F.coalesce(F.col(_COPIES), F.lit(1)) - 1)
    right = _marked(small, on, heavy).withColumn(_SALT, F.explode(copies)).drop(_KEY, _COPIES)
    return left.join(right, [*on, _SALT], how).drop(_SALT)
