"""Places and running sums along an order, without a key's rows in one task.

Rows are dealt to partitions by ranges of (keys, order).  Inside a partition a window counts; what all partitions before it hold of a key
is a sum over one row a partition and key.  Ties at the border of two partitions cannot be: rows equal in keys and order are in one range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged


def running(df: DataFrame, keys: list[str], order: list[str], add: dict[str, str]) -> DataFrame:
    """``df`` with, for each new column of ``add``, the sum of the other column over the rows of the key that come before in the order.

    Rows that agree in keys and order come in any order among themselves.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = staged(df.repartitionByRange(n, *keys, *order).withColumn("range", F.spark_partition_id()), "ranges")
    totals = laid.groupBy(*keys, "range").agg(*[F.sum(v).alias(f"all_{k}") for k, v in add.items()])
    upto = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, "range", *[F.coalesce(F.sum(f"all_{k}").over(upto), F.lit(0)).alias(f"base_{k}") for k in add])
    here = Window.partitionBy(*keys, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = laid.select("*", *[F.coalesce(F.sum(v).over(here), F.lit(0)).alias(f"here_{k}") for k, v in add.items()]).join(bases, [*keys, "range"])
    return rows.select(*df.columns, *[(F.col(f"here_{k}") + F.col(f"base_{k}")).alias(k) for k in add])


def placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``place``: how many rows of the key come before (from 0, without gaps)."""
    return running(df.withColumn("one_", F.lit(1).cast("long")), keys, order, {"place": "one_"}).drop("one_")


def mid_ranks(df: DataFrame, keys: list[str], value: str, mark: str) -> DataFrame:
    """One row a key and distinct value: (keys, value, n, marked, before): its rows, those with ``mark`` true, and the key's rows with lesser values.

    Equal values are counted before anything is shuffled, so a value that a third of all rows have is one row.  Null values are left out.
    """
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.sum(F.col(mark).cast("long")).alias("marked"))
    return running(each, keys, [value], {"before": "n"})


def rank_sum(df: DataFrame, keys: list[str], value: str, mark: str) -> DataFrame:
    """(keys, n1, n2, z): the two-sample rank-sum statistic of the rows with ``mark`` against the others, ties by mean ranks, without a tie correction of the variance.

    z is null where a side is empty.  Null values are left out; a null mark counts as false.
    """
    rows = mid_ranks(df.withColumn("mark_", F.coalesce(F.col(mark), F.lit(False))), keys, value, "mark_")
    s = rows.groupBy(*keys).agg(F.sum("marked").alias("n1"), F.sum("n").alias("all"), F.sum(F.col("marked") * (F.col("before") + (F.col("n") + 1) / 2)).alias("w"))
    n1, n2 = F.col("n1"), F.col("all") - F.col("n1")
    z = (F.col("w") - n1 * (F.col("all") + 1) / 2) / F.nullif(F.sqrt(n1 * n2 * (F.col("all") + 1) / 12), F.lit(0.0))
    return s.select(*keys, "n1", n2.alias("n2"), F.round(z, 5).alias("z"))
