"""Pairing of requests and answers within a key, first in first out."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_in_first_out(rows: DataFrame, key: list[str], order: str, opens: str) -> DataFrame:
    """Answers (rows that don't open) with `opened_by`, the order of the request each takes: the earliest not yet taken,
    and `waiting`, how many requests were open then.

    An answer finds the queue empty when it brings the running balance of requests and answers to a new low below zero;
    such answers are orphans (null) and don't shift later ones. All others take requests in their order, so the n-th of
    them takes the n-th request. Two windows and an equi-join, no state.
    """
    upto = Window.partitionBy(*key).orderBy(order)
    balanced = rows.withColumn("_level", F.sum(F.when(F.col(opens), 1).otherwise(-1)).over(upto))
    before = F.least(F.lit(0), F.coalesce(F.min("_level").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    marked = balanced.withColumn("_orphan", ~F.col(opens) & (F.col("_level") < before))
    taken = F.sum(F.when(F.col(opens), 1).when(~F.col("_orphan"), -1).otherwise(0)).over(upto.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("waiting", F.coalesce(taken, F.lit(0)))
    numbered = marked.withColumn(
        "_n",
        F.when(F.col(opens), F.sum(F.col(opens).cast("int")).over(upto)).when(
            ~F.col("_orphan"), F.sum((~F.col(opens) & ~F.col("_orphan")).cast("int")).over(upto)
        )
    )
    answers = numbered.where(~F.col(opens)).drop(opens, "_level")
    requests = numbered.where(opens).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_n").alias("_request"), F.col(order).alias("opened_by")
    )
    same = F.col("_n") == F.col("_request")
    for i, k in enumerate(key):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    return answers.join(requests, same, "left").drop("_n", "_request", "_orphan", *[f"_k{i}" for i in range(len(key))])
