"""Building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.session import store

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
FIXED_WIDTH = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """More tasks for row-wise work when the input has fewer splits than the cluster has cores.

    Large inputs have splits enough and are returned as they are, without a shuffle. ``key`` should be a unique column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure at most ``max_rows + 1`` rows: is the whole table small enough to copy to every executor?"""
    width = F.length(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.sum(width.cast("long"))).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def driver_blocks(df: DataFrame, size: Column, limit: int) -> Iterator[pa.Table]:
    """The rows of a side that is small, or goes through the driver block by block: each block has about ``limit`` of ``size``.

    The side is stored once and measured there, so a block is read and not worked out again; only one is held at a time.
    """
    rows = store(df.withColumn("_size", size.cast("long")), "driver-blocks")
    count, total = rows.agg(F.count("*"), F.sum("_size")).first()
    blocks = max(1, -(-(total or 0) // limit))
    for i in range(blocks if count else 0):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64(*df.columns), F.lit(blocks)) == i)
        found = part.drop("_size").toArrow()
        if found.num_rows:
            yield found


def spread_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    *,
    small_fits: bool,
    spread_by: Column,
    salts: int = 32,
    how: str = "inner",
) -> DataFrame:
    """Join a big table, whose key may be hot, with a smaller one.

    A measured small side is broadcast, so the big side is not shuffled at all. Otherwise rows of a hot key are
    spread over ``salts`` partitions by a hash of ``spread_by`` and the smaller side is repeated once per salt.
    """
    if small_fits:
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark keeps at most k rows per group and task before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def running_total(
    df: DataFrame, group: str, position: str, value: Column, out: str, block: int = 65_536
) -> DataFrame:
    """Sum of ``value`` over all earlier positions of the group (0 for the first one).

    Positions are cut into blocks: totals are summed per (group, block) with map-side combine, running totals are
    taken over the few block rows, and only the rows of one block meet in a task. A group that holds a third of the
    table is thus spread over many tasks. ``block`` bounds the rows per task for positions without repeats.
    """
    rows = df.withColumn("_value", value).withColumn(
        "_block", F.floor(F.col(position) / F.lit(block)).cast("long")
    )
    over_blocks = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        rows.groupBy(group, "_block")
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(over_blocks), F.lit(0)))
        .drop("_total")
    )
    inside = Window.partitionBy(group, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(blocks, [group, "_block"])
        .withColumn(out, F.col("_before") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_value", "_block", "_before")
    )


def sequential_ids(df: DataFrame, order: str, out: str = "seq", range_rows: int = 1_000_000) -> DataFrame:
    """Number all rows 1..n in the order of a unique column without a single-task window.

    The rows are range partitioned, about ``range_rows`` a range, sorted inside and stored with their place in their range. The counts
    of the ranges, one small row each, give every range its start, so a row's number is one look-up and one sum: no window over
    the rows, no second shuffle. As the places are stored, a task repeated after a lost executor numbers its rows the same way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    ranges = max(cores, -(-df.select(order).count() // range_rows))
    ordered = df.repartitionByRange(ranges, order).sortWithinPartitions(order)
    # the id is the number of the partition in its upper 31 bits and the place in it in the lower 33
    placed = store(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row per range of about a million rows
    return (
        placed.join(F.broadcast(starts), "_range")
        .withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("_range", "_before", "_at")
    )


def heavy_keys(df: DataFrame, key: str, share: float, tracked: int = 10_000) -> dict[object, int]:
    """Keys that hold more than ``share`` of the rows, with their counts: a sketch, merged map-side, of one column.

    The sketch tracks ``tracked`` keys, so a share of a few thousandths is always seen; there are at most 1 / share of them.
    """
    top = F.expr(f"approx_top_k(`{key}`, {max(1, min(tracked // 4, int(1 / share)))}, {tracked})")
    row = df.agg(F.count(key).alias("n"), top.alias("top")).first()
    return {r["item"]: r["count"] for r in row["top"] or [] if r["item"] is not None and r["count"] > share * row["n"]}


def hot_join(big: DataFrame, small: DataFrame, key: str, spread_by: Column, how: str = "inner", tasks: int | None = None) -> DataFrame:
    """Join on a key of which a few values may hold a large share of ``big``.

    A sketch finds these values. Their rows in ``big`` are dealt to as many tasks as their count asks for, by a hash of
    ``spread_by``, and their rows in ``small`` are repeated once for each; all other rows take part as they are. Both sides are
    read once by the join, and without heavy keys it is the plain join. ``how`` is inner, left or left_semi.
    """
    tasks = tasks or int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(big, key, 1 / (2 * tasks))
    if not heavy or how not in ("inner", "left", "left_semi"):
        return big.join(small, key, how)
    total = sum(heavy.values())
    share = max(1, total // tasks)  # what a task gets of the heavy rows
    parts = {k: min(4 * tasks, 4 * -(-n // share)) for k, n in heavy.items()}
    kind = big.schema[key].dataType
    counts = F.create_map(*[c for k, n in parts.items() for c in (F.lit(k).cast(kind), F.lit(n))])
    pieces = F.coalesce(F.try_element_at(counts, F.col(key)), F.lit(1))
    dealt = big.withColumn("_piece", F.pmod(F.xxhash64(spread_by), pieces).cast("int"))
    repeated = small.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return dealt.join(repeated, [key, "_piece"], how).drop("_piece")


def last_per_key(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Row with the highest position per key. An aggregate, so a hot key is combined before the shuffle.

    Columns of fixed width are one ``max_by`` each, which a hash aggregate updates in place; all of them see the same rows in the same
    order, so they agree on the row also where positions tie. With others the row travels as one struct.
    """
    rest = [c for c in df.columns if c not in keys]
    fixed = all(df.schema[c].dataType.simpleString() in FIXED_WIDTH for c in rest)
    if fixed:
        return df.groupBy(*keys).agg(*[F.max_by(c, position).alias(c) for c in rest])
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(position)).alias("_row"))
    return kept.select(*keys, "_row.*")
