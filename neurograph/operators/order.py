"""The next row in a global order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounds(df: DataFrame, column: str, parts: int) -> list[Column]:
    """Up to ``parts`` - 1 values of ``column`` (a number or a time), as literals of its type, that cut its rows into about even parts."""
    kind = df.schema[column].dataType.simpleString()
    shares = [k / parts for k in range(1, parts)]
    found = df.agg(F.transform(F.percentile_approx(column, shares, 10_000), lambda x: x.cast("string"))).first()[0] if shares else None
    return [F.lit(x).cast(kind) for x in dict.fromkeys(found or [])]


def part_of(column: str, cuts: list[Column]) -> Column:
    """The number of the cuts below a row's value, by a tree of comparisons; -1 of a null."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) <= cuts[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(F.col(column).isNull(), F.lit(-1)).otherwise(tree(0, len(cuts)))


def with_next(df: DataFrame, value: str, order: list[str], out: str = "next") -> DataFrame:
    """``df`` with the ``value`` of the next row in ``order``, whose first column is a number or a time.

    Rows find their next one inside their part of that column's range; parts have about equal numbers of rows, as many as there are shuffle partitions. A
    part's last row takes the first value of the next part, found over one row a part (the single-task window that Spark warns of).
    """
    cuts = bounds(df, order[0], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.withColumn("_b", part_of(order[0], cuts))
    within = Window.partitionBy("_b").orderBy(*order)
    inside = rows.withColumn("_in", F.lead(value).over(within)).withColumn("_last", F.lead(F.lit(1)).over(within).isNull())
    firsts = rows.groupBy("_b").agg(F.min_by(value, F.struct(*order)).alias("_f"))
    following = firsts.select("_b", F.lead("_f").over(Window.orderBy("_b")).alias("_over"))
    return inside.join(F.broadcast(following), "_b").withColumn(out, F.when(F.col("_last"), F.col("_over")).otherwise(F.col("_in"))).drop("_b", "_in", "_last", "_over")
