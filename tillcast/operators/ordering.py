"""Order-dependent work on whole tables without a single-task sort.

A table is stored in ranges of its sort key, each sorted; the number of ranges follows from the
number of rows. What is carried between ranges is one summary row per range. Results never depend
on where the ranges were cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

from tillcast.session import materialize, small

#: Rows of a range, and of a block with its own windows.
RANGE_ROWS = 1_000_000
BLOCK_ROWS = 100_000


def _key(cols: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def with_range(
    df: DataFrame, order_cols: list[str], name: str, rows: int | None = None, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """The table stored in sorted ranges, with their ascending number.

    Spark samples the cut points; the stored range of a row cannot change any more, so a lost
    executor does no harm. ``rows`` spares the count where it is known. Only a key that is not
    unique can make a range larger than the others.
    """
    rows = df.count() if rows is None else rows
    ranges = max(1, -(-rows // range_rows))
    dealt = df.repartitionByRange(ranges, *order_cols).sortWithinPartitions(*order_cols)
    return materialize(dealt.withColumn(name, F.spark_partition_id()), "ranges")


def with_position(
    df: DataFrame, order_cols: list[str], name: str = "position", rows: int | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add the 0-based position of every row in the order of ``order_cols`` (a unique key)."""
    ranged = with_range(df, order_cols, "__range", rows, range_rows)
    offsets = _range_offsets(ranged)
    in_range = F.row_number().over(W.partitionBy("__range").orderBy(*order_cols)) - 1
    return (
        ranged.join(offsets, "__range")
        .withColumn(name, (F.col("__offset") + in_range).cast("bigint"))
        .drop("__range", "__offset")
    )


def _range_offsets(ranged: DataFrame) -> DataFrame:
    """(range, rows before it): one row for each range, broadcast if they are few."""
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    return small(materialize(counts.select(
        "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    ), "offsets"))


def keys_at(
    df: DataFrame, ranks: dict[str, Column], coarse: str, fine: list[str], total: str = "total",
    range_rows: int = RANGE_ROWS,
) -> dict[str, Row]:
    """The keys at given 0-based positions of the (coarse, fine) order, as rows by name.

    A rank is an expression over the row count, named ``total``; one past the end is left out.
    Counts per coarse value, a calendar day, find the values that hold the positions: they are
    placed inside Spark and one row per rank is fetched. Only the keys of those values are then
    put in order, by ranges.
    """
    counts = df.groupBy(coarse).agg(F.count(F.lit(1)).alias("__n"))
    running = W.orderBy(coarse).rowsBetween(W.unboundedPreceding, -1)
    placed = counts.select(
        F.col(coarse),
        "__n",
        F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__start"),
        F.sum("__n").over(W.partitionBy()).alias(total),
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank"))
            for name, rank in ranks.items()
        ]
    )
    rank = F.col("__w.rank")
    hits = (
        placed.withColumn("__w", F.explode(wanted))
        .filter((rank >= F.col("__start")) & (rank < F.col("__start") + F.col("__n")))
        .select("__w.name", F.col(coarse), "__n", (rank - F.col("__start")).alias("__at"))
    )
    found = {}
    for hit in hits.collect():  # one row per rank
        inside = df.filter(F.col(coarse) == F.lit(hit[coarse])).select(coarse, *fine)
        placed_keys = with_position(inside, fine, "__position", hit["__n"], range_rows)
        key = placed_keys.filter(F.col("__position") == hit["__at"])
        found[hit["name"]] = key.select(coarse, *fine).first()
    return found


def before(key: Row, columns: list[str]) -> Column:
    """Whether a row sorts before ``key``, as plain comparisons that reach the scan."""
    name, *rest = columns
    value = F.lit(key[name])
    if not rest:
        return F.col(name) < value
    return (F.col(name) < value) | ((F.col(name) == value) & before(key, rest))


def with_blocks(
    df: DataFrame, order_cols: list[str], halo: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Cut an ordered table into blocks that can be windowed independently.

    Adds ``__position``, ``__block`` and ``__halo``. The last ``halo`` rows of a block appear a
    second time, marked, at the front of the next one, so a frame of up to ``halo`` preceding
    rows never needs a row from another block. Drop the marked rows after the window.
    """
    if halo > block_rows:
        raise ValueError(f"halo of {halo} rows exceeds the block of {block_rows} rows")
    placed = with_position(df, order_cols, "__position")
    block = F.floor(F.col("__position") / F.lit(block_rows)).cast("bigint")
    near_end = F.col("__position") % block_rows >= block_rows - halo
    own = F.struct(block.alias("__block"), F.lit(False).alias("__halo"))
    copy = F.struct((block + 1).alias("__block"), F.lit(True).alias("__halo"))
    return placed.withColumn(
        "__place", F.explode(F.when(near_end, F.array(own, copy)).otherwise(F.array(own)))
    ).select(*placed.columns, "__place.__block", "__place.__halo")


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("__halo")).drop("__position", "__block", "__halo")


def carry_fill(
    df: DataFrame, order_cols: list[str], columns: list[str], range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Fill nulls forward, then backward, over the whole table in the order of ``order_cols``.

    Each range is filled alone; the last and first non-null value of every range are carried
    across ranges, one row for each of them.
    """
    ranged = with_range(df, order_cols, "__range", range_rows=range_rows)
    position = _key(order_cols)
    edges = ranged.groupBy("__range").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"__last_{c}")
            for c in columns
        ],
        *[
            F.min_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"__first_{c}")
            for c in columns
        ],
    )
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(F.col("__range").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = materialize(edges.select(
        "__range",
        *[F.last(f"__last_{c}", True).over(before).alias(f"__before_{c}") for c in columns],
        *[F.last(f"__first_{c}", True).over(after).alias(f"__after_{c}") for c in columns],
    ), "carried")
    inside = W.partitionBy("__range").orderBy(*order_cols)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    whole = inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = ranged.join(small(carried), "__range").withColumns(
        {
            c: F.coalesce(
                F.last(c, True).over(upto),
                F.col(f"__before_{c}"),
                F.first(c, True).over(whole),
                F.col(f"__after_{c}"),
            )
            for c in columns
        }
    )
    return filled.select(*df.columns)
