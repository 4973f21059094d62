"""Places of rows inside their groups, without a task that holds a group.

The table is stored in sorted ranges of (group, order); a row's place follows from its range, its
place there, and one summary row for each group of a range. A hot group spreads over many ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tillcast.operators.ordering import with_position
from tillcast.session import materialize, small

#: Rows of a range, and ranges of a table at most; beyond that ranges grow with the rows.
RANGE_ROWS = 20_000
MAX_RANGES = 20_000
_ROW_BITS = 33


def placed(rows: DataFrame, group: str, order: list[str], numbered: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``place`` (0-based, in the order of ``order``, nulls first) and ``group_size``.

    ``rows`` is read three times (to count, to sample, to store) and has no column ``place``,
    ``group_size`` or ``group_no`` of its own. Rows equal in group and order are told apart by
    where they were read, so many of them do no harm. With ``numbered``, ``group_no`` counts the groups in ascending order, null first.
    """
    total = rows.count()
    ranges = max(1, min(MAX_RANGES, -(-total // range_rows)))
    tie = F.xxhash64(F.monotonically_increasing_id())
    keyed = rows.withColumn("__tie", tie)
    keys = [group, *order, "__tie"]
    stored = materialize(
        keyed.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
        .withColumn("__id", F.monotonically_increasing_id()).drop("__tie"), "placed",
    )
    stored = stored.withColumns({
        "__range": F.shiftright("__id", _ROW_BITS),
        "__row": F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
    })
    parts = stored.groupBy("__range", group).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    inside = W.partitionBy(group)
    before = inside.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    parts = materialize(parts.select(
        "__range", group, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__n").over(inside).alias("group_size"),
    ), "parts")
    if numbered:
        groups = with_position(parts.select(group).distinct(), [group], "group_no")
        parts = parts.join(small(materialize(groups, "groups")).withColumnRenamed(group, "__named"), F.col(group).eqNullSafe(F.col("__named"))).drop("__named")
    parts = parts.withColumnsRenamed({"__range": "__r", group: "__g"})
    found = stored.join(small(parts), (F.col("__range") == F.col("__r")) & F.col(group).eqNullSafe(F.col("__g")))
    extra = ["group_no"] if numbered else []
    return found.select(
        *rows.columns, (F.col("__row") + F.col("__shift")).cast("long").alias("place"), F.col("group_size").cast("long"), *extra
    )
