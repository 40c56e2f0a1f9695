"""Dense global positions without gathering all rows in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import new_path

#: Rows that one task numbers; more are dealt to ranges.
FEW = 50_000
#: Rows of a range, about: what a task sorts, so its memory doesn't follow the table.
RANGE_ROWS = 250_000


def range_count(spark: SparkSession, n: int) -> int:
    """Ranges for n rows: RANGE_ROWS in each, or fewer to keep all cores busy, but not less than FEW."""
    return max(1, -(-n // RANGE_ROWS), min(spark.sparkContext.defaultParallelism, n // FEW))


def number_ranges(rows: DataFrame, name: str, by: str | None = None) -> Callable[[SparkSession], DataFrame]:
    """Stores rows and returns what reads them, with a number from 0 as name, in the order of partitions and of the rows in each. by: a column that the table is partitioned by.

    Rows are written once, with their partition and their place in it; the numbers of rows of the partitions before are added when they are read.
    """
    dealt = rows.withColumn("_at", F.monotonically_increasing_id())  # the partition, shifted, and the row's place in it
    path = new_path(rows.sparkSession, "numbered")
    if by:
        dealt.sortWithinPartitions(by, "_at").write.partitionBy(by).parquet(path)
    else:
        dealt.write.parquet(path)
    part, table = F.shiftright("_at", 33).cast("int"), lambda spark: spark.read.schema(dealt.schema).parquet(path)
    sizes = {r.part: r.n for r in table(rows.sparkSession).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = [0]
    for k in range(max(sizes, default=0)):
        starts.append(starts[-1] + sizes.get(k, 0))
    # One literal, whatever the number of partitions.
    start = F.get(F.split(F.lit(",".join(map(str, starts))), ",").cast("array<long>"), part)
    place = start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return lambda spark: table(spark).withColumn(name, place.cast("long")).select(*rows.columns, name)


def with_positions(rows: DataFrame, keys: list[str], name: str = "position") -> DataFrame:
    """rows with a position from 0 in the order of keys.

    Rows are dealt to ranges of RANGE_ROWS rows, sorted there and written once; only the number of rows of each range is summed up globally, and a
    position is the sum of the ranges before plus the place inside its own. Rows with equal keys have any order among themselves. FEW rows or less are numbered by one
    task instead; to count so far takes a look at no more than FEW of them.
    """
    if rows.limit(FEW + 1).count() <= FEW:
        return rows.withColumn(name, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long"))
    ranged = rows.repartitionByRange(range_count(rows.sparkSession, rows.count()), *keys).sortWithinPartitions(*keys)
    return number_ranges(ranged, name)(rows.sparkSession)
