"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df computed once: checkpointed to the shared folder where one is set, else kept in memory and on disk."""
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist()


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """df with the columns of a one-row table: an equality join on a constant whose small side is one row by construction."""
    small = one_row.limit(1).withColumn("__one", F.lit(1))
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(small), "__one").drop("__one")


def xlog2x(x: Column) -> Column:
    """x * log2(x), 0 at 0."""
    return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null unless b is positive."""
    return F.when(b > 0, a.cast("double") / b.cast("double"))


def n_pairs(n: Column) -> Column:
    """n choose 2."""
    return F.floor(n * (n - 1) / 2).cast("long")


def running(df: DataFrame, order: str, sums: dict[str, str], buckets: int = 1024, by: tuple[str, ...] = ()) -> DataFrame:
    """Inclusive running sums in the order of a column in [0, 1], without sorting everything in one task.

    sums: new name to summed column. Totals per range of the order column come
    first (at most `buckets` rows for each value of `by`), then sums inside a range.
    """
    ranged = df.withColumn("__range", F.least(F.floor(F.col(order) * buckets), F.lit(buckets - 1)).cast("int"))
    totals = ranged.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    upto = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "__range", *[F.coalesce(F.sum(f"__t_{n}").over(upto), F.lit(0.0)).alias(f"__s_{n}") for n in sums])
    inside = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(starts, [*by, "__range"])
    return out.withColumns({n: F.col(n) + F.col(f"__s_{n}") for n in sums}).drop("__range", *[f"__s_{n}" for n in sums])
